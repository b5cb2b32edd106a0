"""Benchmark passages in documents, found in a latent space of TF-IDF passages and confirmed word by word.

1. Words are lower-cased and stripped of marks at their ends. Documents become runs of numbers of those words that occur
   in the benchmark (others stay as places without number), which one pass over the texts writes; it also counts in how
   many documents each word is, over all of them.
2. Benchmark items are cut into passages of at most ``PASSAGE`` words. Windows of documents and benchmark passages, each
   half of the weight, are rows of a TF-IDF matrix A of unit rows. Its right singular vectors come from a randomised SVD:
   each task adds up its share of ``A'A M`` for a narrow random M, once more for the basis that gives, and only sums of the
   size of vocabulary x rank leave the tasks.
3. Every window, ``STRIDE`` words apart, is compared with all passages by cosine in that space. Two sizes of window are
   used, so that a passage always lies whole in a window not much longer than itself.
4. A candidate counts if the longest common subsequence of words covers ``SURE`` of the passage, or ``MAYBE`` of it and
   the passage's answer stands there too: paraphrases keep it.

The benchmark is the query set: it is taken in blocks of ``BLOCK_ITEMS`` items, which bounds what tasks hold. Every
window of every document is compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from verdikt.llm.batches import slices, split_words
from verdikt.operators.lineage import cut_lineage

PASSAGE, STRIDE = 48, 16
#: Blocks of STRIDE words in a window, and the longest passage that always lies whole in it.
WINDOWS = {2: 16, 4: 48}
RANK, SEED = 96, 31
COSINE = 0.5
SURE, MAYBE, ANSWER_WORDS, ANSWER_SHARE = 0.7, 0.6, 4, 0.75
#: Words in more than this share of documents say little and are left out of vectors, not out of step 4.
COMMON = 0.1
BLOCK_ITEMS = 5_000
#: Bytes of coded documents that a task looks at together.
RUN_BYTES = 1 << 20

_ENDS = r"^[^\pL\pN]+|[^\pL\pN]+$"


def _strip(words: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(words, _ENDS, "")


def plain_words(text: str | None) -> list[str]:
    """The words of a text as they are compared."""
    offsets, codes, words = split_words(pc.utf8_lower(pa.array([text], pa.string())))
    return [w for w in _strip(words).take(pa.array(codes)).to_pylist() if w]


class Passage(NamedTuple):
    item_id: int
    words: list[int]
    answer: list[int]


def passages(items: pd.DataFrame) -> tuple[list[str], list[Passage]]:
    """``vocabulary, passages`` of items. The answer is the column of that name, or else the last words of a passage."""
    numbers: dict[str, int] = {}
    out = []
    for row in items.itertuples():
        words = [numbers.setdefault(w, len(numbers)) for w in plain_words(row.text)]
        given = [numbers.setdefault(w, len(numbers)) for w in plain_words(row.answer)]
        parts = -(-len(words) // PASSAGE)
        for piece in np.array_split(np.array(words, np.int64), parts) if parts else []:
            out.append(Passage(row.item_id, piece.tolist(), given or piece[-ANSWER_WORDS:].tolist()))
    return list(numbers), out


def _code(vocabulary: list[str]):
    """Numbers of a document's words, and of each slice in how many of its documents each word is."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_string())
        for part in slices(batches, "text"):
            offsets, codes, words = split_words(pc.utf8_lower(part["text"]))
            words = _strip(words)
            number = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
            kept = real[codes]
            ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
            ids = number[codes[kept]]
            owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            have = ids >= 0
            once = np.unique(owner[have] * len(vocabulary) + ids[have]) % max(1, len(vocabulary))
            seen = np.bincount(once, minlength=len(vocabulary))
            found = np.flatnonzero(seen)
            blob = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * 4), pa.py_buffer(ids.tobytes())])
            n = part.num_rows
            none = pa.nulls(n, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["digest"], blob.cast(pa.binary()), none, none], ["doc_id", "digest", "ids", "words", "docs"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                              pa.array([found], pa.list_(pa.int32())), pa.array([seen[found]], pa.list_(pa.int32()))],
                                             ["doc_id", "digest", "ids", "words", "docs"])
    return run


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """``ids, offsets, rows`` of slices of coded documents."""
    for part in slices(batches, "ids", RUN_BYTES):
        blobs = part["ids"].to_pylist()
        yield np.frombuffer(b"".join(blobs), np.int32), np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]), part


def _blocks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``starts, first``: where blocks of STRIDE words begin, the last of a document shorter, and each document's first."""
    counts = -(-np.diff(offsets) // STRIDE)
    first = np.concatenate([[0], np.cumsum(counts)])
    inner = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    return np.repeat(offsets[:-1], counts) + inner * STRIDE, first


def _gram(ids: np.ndarray, row: np.ndarray, rows: int, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``A'A basis`` for unit TF-IDF rows made of words ``ids``, each in one of ``rows`` rows; no row is empty."""
    pairs, times = np.unique(row * len(idf) + ids, return_counts=True)
    row, word = np.divmod(pairs, len(idf))
    value = (times * idf[word]).astype(np.float32)
    value /= np.sqrt(np.bincount(row, value * value, rows)[row]).astype(np.float32)
    projected = np.add.reduceat(basis[word] * value[:, None], np.searchsorted(row, np.arange(rows)), axis=0)
    order = np.argsort(word, kind="stable")
    row, word, value = row[order], word[order], value[order]
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(basis.shape)
    out[word[starts]] = np.add.reduceat(projected[row] * value[:, None], starts, axis=0)
    return out


def _latent_basis(coded: DataFrame, items: list[Passage], idf: np.ndarray) -> np.ndarray:
    """Right singular vectors, vocabulary x rank, the strongest first."""
    rng = np.random.default_rng(SEED)
    d, rank = len(idf), min(RANK, len(idf))
    lens = [len(p.words) for p in items]
    own = np.repeat(np.arange(len(items)), lens)
    words = np.concatenate([np.array(p.words, np.int64) for p in items])
    kept = idf[words] > 0
    own, words = np.unique(own[kept], return_inverse=True)[1], words[kept]
    schema = "word int, " + ", ".join(f"y{k} double" for k in range(rank)) + ", n double"

    def product(basis: np.ndarray) -> np.ndarray:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((d, rank)), 0
            for ids, offsets, _ in _runs(batches):
                starts, first = _blocks(offsets)
                block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
                # Side by side here, so that each word counts once.
                window = (first[:-1][np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] + block) // max(WINDOWS)
                use = ids >= 0
                use[use] = idf[ids[use]] > 0
                if use.any():
                    distinct, row = np.unique(window[use], return_inverse=True)
                    total += _gram(ids[use].astype(np.int64), row, len(distinct), idf, basis)
                    n += len(distinct)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), *[pa.array(total[:, k]) for k in range(rank)],
                                                  pa.array(np.where(np.arange(d) == 0, float(n), 0.0))], ["word", *[f"y{k}" for k in range(rank)], "n"])

        # A row a word comes back: vocabulary x rank numbers, whatever the corpus.
        got = coded.mapInArrow(run, schema).groupBy("word").agg(*[F.sum(f"y{k}").alias(f"y{k}") for k in range(rank)], F.sum("n").alias("n")).toPandas()
        total = np.zeros((d, rank))
        if len(got):
            total[got["word"].to_numpy()] = got[[f"y{k}" for k in range(rank)]].to_numpy()
        n = got["n"].sum() if len(got) else 0
        bench = _gram(words, own, own.max() + 1, idf, basis) if len(words) else np.zeros((d, rank))
        return bench / len(items) + (total / n if n else 0)

    basis = np.linalg.qr(product(rng.normal(size=(d, rank)).astype(np.float32)))[0]
    inner = basis.T @ product(basis.astype(np.float32))
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return (basis @ turn[:, ::-1])[:, values[::-1] > 1e-12 * max(values.max(), 0)].astype(np.float32)


def common_subsequence(bits: dict[int, int], length: int, text: list[int]) -> int:
    """Length of the longest common subsequence of a passage, as bit masks of each word's places, with ``text``."""
    full = (1 << length) - 1
    left = full
    for word in text:
        mask = bits.get(word)
        if mask:
            hit = left & mask
            left = ((left + hit) | (left - hit)) & full
    return length - left.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def _search(items: list[Passage], rarity: np.ndarray, idf: np.ndarray, basis: np.ndarray):
    masks = [_masks(p.words) for p in items]
    spectrum = np.stack([(idf[p.words][:, None] * basis[p.words]).sum(axis=0) for p in items])
    size = np.linalg.norm(spectrum, axis=1)
    spectrum = (spectrum / np.maximum(size, 1e-12)[:, None]).astype(np.float32)
    weights = (basis * idf[:, None]).astype(np.float32)
    lens = np.array([len(p.words) for p in items])
    needed = np.array([len(p.words) * MAYBE for p in items])
    kinds = [(blocks, np.flatnonzero((lens <= longest) & (lens > shorter))) for (blocks, longest), shorter in zip(WINDOWS.items(), [0, *WINDOWS.values()])]

    def confirm(near: float, item: int, text: list[int]) -> float | None:
        p = items[item]
        share = common_subsequence(masks[item], len(p.words), text) / len(p.words)
        if share >= SURE:
            return share
        # Of an answer the rare words tell; common ones stand everywhere.
        there, worth = set(text), rarity[p.answer]
        return share if share >= MAYBE and worth[[w in there for w in p.answer]].sum() >= ANSWER_SHARE * worth.sum() else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, offsets, part in _runs(batches):
            starts, first = _blocks(offsets)
            found = []
            if len(starts):
                bounds = np.append(starts, len(ids))
                block = np.repeat(np.arange(len(starts)), np.diff(bounds))
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                known = np.add.reduceat((ids >= 0).astype(np.int64), starts)
                heavy = np.flatnonzero(ids >= 0)
                heavy = heavy[idf[ids[heavy]] > 0]
                edges = np.searchsorted(block[heavy], np.arange(len(starts) + 1))
                per_block = np.concatenate([np.add.reduceat(weights[ids[heavy[a:b]]], (edges[x:y] - a)[(m := np.diff(edges[x:y + 1]) > 0)], axis=0)
                                            if b > a else np.zeros((0, weights.shape[1]), np.float32)
                                            for x, y, a, b in _spans(edges, 200_000)])
                full = np.diff(edges) > 0
                place = np.cumsum(full) - 1
                for blocks, chosen in kinds:
                    if not len(chosen):
                        continue
                    # A window that begins at each block and ends with its document; too few known words cannot match.
                    last = np.minimum(np.arange(len(starts)) + blocks, first[owner + 1])
                    total = np.concatenate([[0], np.cumsum(known)])
                    able = np.flatnonzero(total[last] - total[:-1] >= needed[chosen].min())
                    for a in range(0, len(able), 8192):
                        at = able[a:a + 8192]
                        vector = np.zeros((len(at), weights.shape[1]), np.float32)
                        for step in range(blocks):
                            b = at + step
                            ok = b < last[at]
                            ok[ok] = full[b[ok]]
                            vector[ok] += per_block[place[b[ok]]]
                        norm = np.linalg.norm(vector, axis=1)
                        near = (vector / np.maximum(norm, 1e-12)[:, None]) @ spectrum[chosen].T
                        for w, c in zip(*np.nonzero((near >= COSINE) | (size[chosen] < 1e-9)[None, :])):
                            start = int(at[w])
                            item, doc = int(chosen[c]), int(owner[start])
                            stop = min(int(bounds[last[start]]) + STRIDE, int(offsets[doc + 1]))
                            share = confirm(float(near[w, c]), item, ids[max(bounds[start] - STRIDE, offsets[doc]):stop].tolist())
                            if share is not None:
                                found.append((doc, items[item].item_id, float(near[w, c]), share, int(bounds[start] - offsets[doc])))
            docs = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([part["doc_id"].take(docs), part["digest"].take(docs), pa.array([f[1] for f in found], pa.int64()),
                                              pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.float64()),
                                              pa.array([f[4] for f in found], pa.int64())], ["doc_id", "digest", "item_id", "cosine", "overlap", "at"])
    return run


def _spans(edges: np.ndarray, limit: int) -> Iterator[tuple[int, int, int, int]]:
    """``x, y, a, b``: runs of blocks x to y whose entries a to b are about ``limit``."""
    x = 0
    while x < len(edges) - 1:
        y = max(x + 1, int(np.searchsorted(edges, edges[x] + limit, "right")) - 1)
        yield x, y, int(edges[x]), int(edges[y])
        x = y


def _digest() -> Column:
    return F.xxhash64("text", F.octet_length("text"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, overlap, at``: documents that hold a passage of a benchmark item, a row a pair.

    ``docs(doc_id, text)``, ``benchmark(item_id, text[, answer])``. ``overlap`` is the share of the passage found in
    order, ``at`` the word where the best window begins. Rows of one doc_id are one; a null doc_id is kept as such. Null
    and empty texts and items without words match nothing; empty tables give an empty result.
    """
    found = _hits(docs, benchmark)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("overlap", "cosine", (-F.col("at")).alias("at"))).alias("b")).select(
        "doc_id", "item_id", "b.cosine", "b.overlap", (-F.col("b.at")).alias("at"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark passage. Equal texts share their fate, whatever their ids."""
    marks = _hits(docs, benchmark).select("digest").distinct().withColumnRenamed("digest", "_leak")
    return docs.join(marks, _digest() == F.col("_leak"), "left_anti")


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer.alias("answer"))
    blocks = -(-items.count() // BLOCK_ITEMS)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", _digest())
    schema = "doc_id long, digest long, item_id long, cosine double, overlap double, at long"
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toPandas().sort_values(["item_id", "text"])
        vocabulary, cut = passages(own)
        if not cut:
            continue
        coded = cut_lineage(texts.mapInArrow(_code(vocabulary), "doc_id long, digest long, ids binary, words array<int>, docs array<int>"))
        runs = coded.where("ids is not null").select("doc_id", "digest", "ids")
        count = runs.count()
        seen = (coded.where("words is not null").select(F.explode(F.arrays_zip("words", "docs")).alias("z"))
                .groupBy(F.col("z.words").alias("word")).agg(F.sum("z.docs").alias("n")).toPandas())
        df = np.zeros(len(vocabulary))
        df[seen["word"].to_numpy(dtype=np.int64)] = seen["n"].to_numpy()
        rarity = np.log((count + 1) / (df + 0.5)).clip(0.05)
        idf = _weights(df, count, rarity, cut)
        basis = _latent_basis(runs, cut, idf)
        out = out.unionByName(cut_lineage(runs.mapInArrow(_search(cut, rarity, idf, basis), schema)))
    return out


def _weights(df: np.ndarray, count: int, idf: np.ndarray, items: list[Passage]) -> np.ndarray:
    """IDF of each word; zero for common ones, unless a passage would lose more than half of its words."""
    rare = df <= COMMON * count
    weight = np.where(rare, idf, 0)
    for p in items:
        if rare[p.words].mean() < 0.5:
            by_worth = sorted(set(p.words), key=lambda w: (-idf[w], w))
            for w in by_worth[:-(-len(by_worth) // 2)]:
                weight[w] = idf[w]
    return weight
