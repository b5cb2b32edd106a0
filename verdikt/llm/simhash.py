"""Near-duplicates by SimHash fingerprints, linked through BK-trees.

A fingerprint has 64 bits; two link if they differ in ``RADIUS`` bits or fewer. Such a pair agrees in one of
``RADIUS + 1`` bands of bits, so distinct fingerprints are dealt out by band value and each shard of equal value builds
its own BK-tree, in which only edges within the radius are followed. A tree is met by the fingerprints of its shard alone:
trees of the whole corpus grow with it and so are not broadcast. A shard tells who belongs together, not all pairs.

Shards over ``SHARD_ROWS`` distinct fingerprints are linked exactly by another way that splits them: two fingerprints are
at most two bits apart if and only if both are within one bit of some third, so each names those 65 and the smallest
fingerprint at each name is linked with the rest. No name has more than 65 owners.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from verdikt.llm.batches import slices
from verdikt.llm.skew import join_by_counts
from verdikt.operators.graph import connected_components
from verdikt.operators.lineage import cut_lineage

SHINGLE, RADIUS, SEED = 3, 2, 42
BANDS = ((0, 22), (22, 21), (43, 21))
SHARD_ROWS = 2048

_LOW = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``size`` words, A-Z lower-cased; of the whole sequence if it is shorter; none without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[:len(parts) - size + 1].tolist(), ends[size - 1:].tolist())]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts[i]`` hashes the word whose bits are set in over half of them; zero for an empty run.

    Eight bits are counted at a time, in the bytes of a word, over pieces of at most 255 hashes.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    pieces = -(-sizes // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + inner * 255
    first = np.cumsum(pieces) - pieces
    for bit in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(bit)) & _LOW, starts)
        ones = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (2 * ones > sizes[:, None]).astype(np.uint64)
        out[full] |= (over << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


def _fingerprint(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        texts = part["text"].dictionary_encode()
        runs = [shingle_hashes(t) for t in texts.dictionary.to_pylist()]
        counts = np.fromiter(map(len, runs), np.int64, len(runs))
        flat = np.fromiter((h for run in runs for h in run), np.uint64, int(counts.sum()))
        prints = np.append(majority(flat, counts), np.uint64(0)).view(np.int64)
        at = texts.indices.fill_null(len(runs)).to_numpy()
        yield pa.RecordBatch.from_arrays([part["doc_id"], part["digest"], pa.array(prints[at])], ["doc_id", "digest", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, fp`` of every row; the fingerprint of a null or empty text is zero."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _digest().alias("digest")).mapInArrow(
        _fingerprint, "doc_id long, digest long, fp long")


def _digest() -> Column:
    return F.xxhash64(F.col("text").cast("string"), F.octet_length("text"))


class BKTree:
    """Non-negative integers by Hamming distance: a child hangs from its parent under its distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the stored values at most ``radius`` bits away."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            edges = self.children[node]
            for key in range(d - radius, d + radius + 1):
                if key in edges:
                    todo.append(edges[key])
        return found

    def add(self, value: int) -> None:
        """Stores a value that is not there yet."""
        self.values.append(value)
        self.children.append({})
        new, node = len(self.values) - 1, 0
        while node != new:
            node = self.children[node].setdefault((self.values[node] ^ value).bit_count(), new)


def link_shard(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the same values as all pairs within ``radius`` would; at most one a value."""
    tree, top, links = BKTree(), [], []

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for value in values:
        groups = {root(k) for k in tree.within(value, radius)}
        tree.add(value)
        top.append(min(groups, default=len(top)))
        for k in groups:
            top[k] = top[-1]
            links.append((value, tree.values[k]))
    return links


def _link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def linked(values: list[int]) -> pa.RecordBatch:
        pairs = np.array(link_shard(values), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    key, values = None, []
    for batch in batches:
        for shard, fp in zip(zip(batch["band"].to_pylist(), batch["value"].to_pylist()),
                             batch["fp"].to_numpy().view(np.uint64).tolist()):
            if shard != key:
                if len(values) > 1:
                    yield linked(values)
                key, values = shard, []
            values.append(fp)
    if len(values) > 1:
        yield linked(values)


def _band(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """``src, dst``: links between distinct fingerprints ``fp`` whose components are those of all pairs within the radius."""
    banded = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("band"), _band(F.col("fp"), *b).alias("value")) for k, b in enumerate(BANDS)])).alias("s")
    ).select("fp", "s.band", "s.value")
    sizes = cut_lineage(banded.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1"))
    small = sizes.where(F.col("n") <= SHARD_ROWS).drop("n")
    links = (banded.join(small, ["band", "value"], "left_semi").repartition("band", "value")
             .sortWithinPartitions("band", "value", "fp").mapInArrow(_link, "src long, dst long"))
    large = sizes.where(F.col("n") > SHARD_ROWS).drop("n")
    if not large.take(1):
        return links
    # At most three of SHARD_ROWS fingerprints are in a large shard, so this list is short beside the corpus.
    names = (banded.join(large, ["band", "value"], "left_semi").select("fp").distinct()
             .select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)))
                                                            for k in range(64)])).alias("name")))
    near = names.join(names.groupBy("name").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).where("n > 1"), "name")
    return links.union(near.where("fp <> dst").select(F.col("fp").alias("src"), "dst"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over links, null only if no row there has one. Equal fingerprints
    link, so all texts without words form one component. Repeated rows each appear; other columns are ignored; an empty
    table gives an empty result.
    """
    rows, of_print = _components(docs)
    return join_by_counts(rows, of_print.select("fp", "n", F.col("least.doc_id").alias("component_id")), "fp", "n").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their components: of each the smallest doc_id, null last, then the least digest of its text."""
    _, of_print = _components(docs)
    kept = of_print.select(F.coalesce(F.col("least.doc_id").cast("string"), F.lit("")).alias("_id"), F.col("least.digest").alias("_digest")).distinct()
    keyed = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))).withColumn("_digest", _digest())
    return keyed.join(kept, ["_id", "_digest"]).dropDuplicates(["_id", "_digest"]).select(*docs.columns)


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and for each distinct one how many rows have it and the least row of its component."""
    rows = cut_lineage(fingerprints(docs))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    prints = cut_lineage(rows.groupBy("fp").agg(F.min(row).alias("first"), F.count("*").alias("n")))
    nodes = connected_components(fingerprint_links(prints.select("fp")))
    joined = prints.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    return rows, cut_lineage(joined.join(least, "component").select("fp", "n", "least"))
