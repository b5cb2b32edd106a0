"""Cross-entropy difference: how much more like a target text than like the corpus each document reads.

Two bigram models over the ids of one tokenizer file, so over one vocabulary, with the same smoothing: the background
counts all documents, the target those marked. A document's score is the mean over its tokens, and its end, of the loss
under the target model less the loss under the background model: the lower, the more like the target.

The probability of b after a is ``(c(ab) + PRIOR * p(b)) / (c(a) + PRIOR)`` with ``p(b) = (c(b) + 1) / (n + V)``.

Counts of all bigrams of the corpus are gathered, none is pruned, and no task needs them all. Texts are coded in chunks;
a chunk sends its distinct bigrams, sorted and packed, to the parts of the key space that sum them, and gets their totals
back in the same order. So a frequent bigram is one entry a chunk, however many rows have it. What is indexed by single
ids is of the vocabulary's size and travels with the tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from verdikt.llm.batches import SLICE_BYTES, slices
from verdikt.llm.tokens import word_tokenizer
from verdikt.operators.lineage import cut_lineage

PRIOR = 20.0
#: Bigrams that a part sums at once, about.
PART_ROWS = 2_000_000

CODED = "chunk long, doc_ids array<long>, counts array<int>, target array<boolean>, ids binary"


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<u4").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)


def _spread(first: np.ndarray, parts: int) -> np.ndarray:
    """Part of the bigrams that begin with each id."""
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _bigrams(ids: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``keys, owners``: each token after the one before, an edge (id ``size``) at both ends of a document."""
    ends = np.cumsum(counts)
    second = np.insert(ids.astype(np.int64), ends, size)
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[:1] = size
    return first * (size + 1) + second, np.repeat(np.arange(len(counts)), counts + 1)


def _code(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base, k = TaskContext.get().partitionId() << 32, 0
        for part in slices(batches, "text", SLICE_BYTES):
            ids, counts = word_tokenizer(path).encode(part["text"])
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([pa.array([base + k]), one(part["doc_id"].to_pylist(), pa.int64()), one(counts, pa.int32()),
                                              one(part["target"].to_pylist(), pa.bool_()), pa.array([zlib.compress(ids.astype("<u4").tobytes(), 1)], pa.binary())],
                                             ["chunk", "doc_ids", "counts", "target", "ids"])
            k += 1
    return run


def _read(row: dict, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``keys, owners, target`` of a chunk."""
    keys, owners = _bigrams(np.frombuffer(zlib.decompress(row["ids"]), "<u4"), np.array(row["counts"], np.int64), size)
    return keys, owners, np.array(row["target"], bool)


def _send(size: int, parts: int):
    """Distinct bigrams of a chunk with their counts, packed for each part."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, owners, target = _read(row, size)
                found, place = np.unique(keys, return_inverse=True)
                n, t = np.bincount(place), np.bincount(place, target[owners]).astype(np.int64)
                at = _spread(found // (size + 1), parts)
                order = np.argsort(at, kind="stable")
                edges = np.searchsorted(at[order], np.arange(parts + 1))
                rows = [(row["chunk"], p, _pack(np.diff(found[o], prepend=0)), _pack(n[o]), _pack(t[o]))
                        for p in range(parts) if len(o := order[edges[p]:edges[p + 1]])]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.binary()] * 3))],
                                                 ["chunk", "part", "keys", "n", "t"])
    return run


def _sum(table: pa.Table) -> pa.Table:
    """Totals over all chunks, to each chunk in the order of its keys."""
    keys = [np.cumsum(_unpack(k)) for k in table["keys"].to_pylist()]
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = [np.bincount(place, np.concatenate([_unpack(x) for x in table[c].to_pylist()]), len(found)).astype(np.int64)[place] for c in ("n", "t")]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return pa.table({"chunk": table["chunk"], "part": table["part"], "n": [_pack(x) for x in np.split(totals[0], cuts)],
                     "t": [_pack(x) for x in np.split(totals[1], cuts)]},
                    schema=pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("n", pa.binary()), ("t", pa.binary())]))


def _singles(size: int):
    """How often each id stands first and second, of all and of target documents, a few rows a chunk and id."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, size + 1), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                keys, owners, target = _read(row, size)
                for k, chosen in enumerate((keys, keys[target[owners]])):
                    total[2 * k] += np.bincount(chosen // (size + 1), minlength=size + 1)
                    total[2 * k + 1] += np.bincount(chosen % (size + 1), minlength=size + 1)
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(x[used]) for x in total]], ["id", "a", "b", "ta", "tb"])
    return run


def _losses(pair: np.ndarray, first: np.ndarray, second: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """Negative log probability of bigrams ``keys`` that a model has counted ``pair`` times."""
    a, b = np.divmod(keys, size + 1)
    single = (second[b] + 1) / (second.sum() + size + 1)
    return -np.log((pair + PRIOR * single) / (first[a] + PRIOR))


SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def score(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens``, mean ``target_loss`` and ``background_loss`` in nats, and ``score``, their difference.

    ``docs(doc_id, text, target)``: a row with ``target`` true counts for both models; false or null for the background
    alone. Without any target row the target model knows no word better than another. A null or empty text has only its
    end. Repeated rows count, and are scored, each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    coded = cut_lineage(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("target").cast("boolean"), F.lit(False)).alias("target"))
                        .mapInArrow(_code(tokenizer), CODED))
    singles = np.zeros((4, size + 1))
    # One row an id of the vocabulary file comes to the driver.
    counted = (coded.mapInArrow(_singles(size), "id long, a long, b long, ta long, tb long").groupBy("id")
               .agg(*[F.sum(c).alias(c) for c in ("a", "b", "ta", "tb")]).toPandas())
    singles[:, counted["id"].to_numpy(dtype=np.int64)] = counted[["a", "b", "ta", "tb"]].to_numpy(dtype=float).T
    known = spark.sparkContext.broadcast(singles)
    parts = int(singles[0].sum() // PART_ROWS) + 1
    parts = max(parts, min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def finish(key, own: pa.Table, totals: pa.Table) -> pa.Table:
        first, second, t_first, t_second = known.value
        out = []
        by_part = dict(zip(totals["part"].to_pylist(), zip(totals["n"].to_pylist(), totals["t"].to_pylist())))
        for row in own.to_pylist():
            keys, owners, _ = _read(row, size)
            found, place = np.unique(keys, return_inverse=True)
            at = _spread(found // (size + 1), parts)
            order = np.argsort(at, kind="stable")
            back = np.empty((2, len(found)), np.int64)
            back[:, order] = [np.concatenate([_unpack(by_part[p][k]) for p in sorted(by_part)]) for k in (0, 1)]
            loss = [_losses(back[1], t_first, t_second, found, size)[place], _losses(back[0], first, second, found, size)[place]]
            counts = np.array(row["counts"], np.int64)
            means = [np.bincount(owners, x, len(counts)) / (counts + 1) for x in loss]
            out.append(pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": counts, "target_loss": means[0],
                                 "background_loss": means[1], "score": means[0] - means[1]}))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in (
            ("doc_id", pa.int64()), ("n_tokens", pa.int64()), *[(c, pa.float64()) for c in ("target_loss", "background_loss", "score")])})

    totals = (coded.mapInArrow(_send(size, parts), "chunk long, part int, keys binary, n binary, t binary")
              .repartition(parts, "part").groupBy("part").applyInArrow(_sum, "chunk long, part int, n binary, t binary"))
    return coded.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(finish, SCORES)


def with_target(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, text, target``: whether ``wanted`` has the doc_id. Rows without a doc_id are no target and join nothing.

    The list of wanted ids grows with the corpus, so the join is by shuffle at every size.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marks = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(True))
    return docs.where("doc_id is not null").join(marks.hint("merge"), "doc_id", "left").unionByName(
        docs.where("doc_id is null").withColumn("target", F.lit(None).cast("boolean")))
