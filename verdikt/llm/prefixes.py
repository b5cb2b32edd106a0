"""The trie of conversation prefixes, summed up by an Euler tour.

A node is a distinct sequence of first turns. It is known by 128 bits: the exclusive or of a hash of each of its turns
with the turn's place, which runs along a conversation and gives the parent's by taking the last turn out. The tour has
two arcs for each node, enter and exit; the arc after an arc follows from first children and next siblings alone. The list
of arcs is ranked by random mate: in each round an arc that drew heads takes over the arc after it that drew tails, which
leaves about three in four; the last ``REST`` are walked in one task, and rounds are undone in reverse, a joined row for
each arc. Work is in proportion to the arcs. Prefix sums at the arcs' positions, at exit less at enter, are subtree sums.

Edge cases: turns are ordered by turn (null first), then role, then text; a null role or text is empty; a row without a
conv_id belongs to no conversation; rows repeated are turns repeated; extra columns are ignored; without conversations
there is no node, root included. One conversation, one first turn or one parent may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from verdikt.llm.ordered import AT, in_order, ranges, running
from verdikt.llm.skew import join_by_counts
from verdikt.operators.lineage import cut_lineage

#: At most so many arcs are walked in one task; a bound for every input.
REST = 1 << 14
#: Conversation numbers in a piece of the text that is hashed.
PIECE = 4096
WORD = r"[^\x20\x09-\x0D]+"

_XOR = lambda a, b: a.bitwiseXOR(b)
_ADD = lambda a, b: a + b


def placed_turns(conversations: DataFrame) -> DataFrame:
    """``conv, place, a, b, words``: turns by their place from 1, content as two hashes."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *text)
    rows = in_order(turns, [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "conv",
                    F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"),
                    F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    return cut_lineage(running(rows, ["conv"], {"place": (F.count, "*", _ADD)}).select("conv", "place", "a", "b", "words"))


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """``conversations, turns`` with borrowed heads: first crc32(conv) % ``most`` turns are those of the family's first.

    ``conversations`` has ``conv, n, length``: own turns before, turns after.
    """
    crc = lambda c: F.crc32(F.col(c).cast("string").cast("binary"))
    h = lambda c: crc(c) % most
    heads = cut_lineage(turns.where((F.col("place") < most) & (F.col("conv") % family == 0)))
    lengths = heads.groupBy(F.col("conv").alias("base")).agg(F.max("place").alias("has"))
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", (F.col("conv") - F.col("conv") % family).alias("base"), h("conv").alias("h"))
    convs = cut_lineage(convs.join(lengths, "base", "left").withColumn("used", F.least("h", F.coalesce("has", F.lit(0).cast("long"))))
                        .select("conv", "n", "base", "h", "used", (F.col("used") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    borrowed = convs.join(heads.withColumnRenamed("conv", "base"), "base").where("place <= h").select("conv", F.col("place").alias("depth"), "a", "b", "words")
    own = join_by_counts(turns.where(F.col("place") > h("conv")), convs.select("conv", "used", "n"), "conv", "n").select(
        "conv", (F.col("place") - h("conv") + F.col("used")).alias("depth"), "a", "b", "words")
    return convs.select("conv", "n", "length"), borrowed.union(own)


def _key(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def nodes_of(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes, ends``: nodes with what is known without their subtrees, and the node at which each conversation ends."""
    mark = lambda seed: F.xxhash64(F.lit(seed), "depth", "a", "b")
    rows = in_order(turns, [F.col("conv"), F.col("depth")], "conv", "depth", "words", mark(3).alias("own_a"), mark(4).alias("own_b"))
    paths = cut_lineage(running(rows, ["conv"], {"p_a": (F.bit_xor, "own_a", _XOR), "p_b": (F.bit_xor, "own_b", _XOR)}).select(
        "conv", "depth", "words", _key(F.col("p_a"), F.col("p_b")).alias("key"),
        _key(F.col("p_a").bitwiseXOR(F.col("own_a")), F.col("p_b").bitwiseXOR(F.col("own_b"))).alias("parent")))
    root = _key(F.lit(0).cast("long"), F.lit(0).cast("long"))
    below = paths.groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv").alias("conv_id"),
                                     F.count("*").alias("n_convs"), F.min("words").alias("words"))
    top = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        root.alias("key"), F.lit(None).cast("struct<a: bigint, b: bigint>").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    plain = cut_lineage(below.unionByName(top))
    children = plain.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(
        F.count("*").alias("n_children"), F.min(F.struct("conv_id", "key")).alias("first"))
    nodes = cut_lineage(plain.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
                        .withColumn("first", F.col("first.key")))
    last = paths.groupBy("conv").agg(F.max(F.struct("depth", "key")).alias("last")).select("conv", F.col("last.key").alias("key"))
    return nodes, last.union(convs.where("length = 0").select("conv", root.alias("key")))


def _arc(key: str, leaves: bool) -> Column:
    return F.struct(F.col(f"{key}.a").alias("a"), F.col(f"{key}.b").alias("b"), F.lit(leaves).alias("leaves"))


def tour(nodes: DataFrame) -> DataFrame:
    """``arc, next``: the arc after each arc of the tour, null after the last. Siblings go by their smallest conversation."""
    rows = in_order(nodes.where("depth > 0"), [F.col("parent.a"), F.col("parent.b"), F.col("conv_id")], "key", "parent")
    firsts = rows.groupBy("_range").agg(F.min_by(F.struct("parent", "key"), AT).alias("first"))
    edges = firsts.select(F.lag("_range").over(W.orderBy("_range")).alias("_range"), F.col("first.parent").alias("parent"), F.col("first.key").alias("over"))
    siblings = (rows.withColumn("sibling", F.lead("key").over(W.partitionBy("_range", "parent").orderBy(AT)))
                .join(F.broadcast(edges.where("_range IS NOT NULL")), ["_range", "parent"], "left")
                .select("key", F.coalesce("sibling", "over").alias("sibling"), "parent"))
    down = nodes.select(_arc("key", False).alias("arc"), F.when(F.col("n_children") > 0, _arc("first", False)).otherwise(_arc("key", True)).alias("next"))
    up = siblings.select(_arc("key", True).alias("arc"), F.when(F.col("sibling").isNotNull(), _arc("sibling", False)).otherwise(_arc("parent", True)).alias("next"))
    last = nodes.where("depth = 0").select(_arc("key", True).alias("arc"), F.lit(None).cast("struct<a: bigint, b: bigint, leaves: boolean>").alias("next"))
    return down.union(up).union(last)


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = [row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("arc", "next", "w")))]
    name = lambda arc: arc and (arc["a"], arc["b"], arc["leaves"])
    before = {name(after): (arc, w) for arc, after, w in table}
    found, left, at = [], 0, None
    while at in before:
        arc, w = before[at]
        left += w
        found.append((arc, left))
        at = name(arc)
    kind = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("leaves", pa.bool_())])
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], kind), pa.array([n for _, n in found], pa.int64())], ["arc", "left"])


def list_rank(links: DataFrame, rest: int = REST) -> DataFrame:
    """``arc, left`` of every arc of a list ``arc, next``: how many arcs there are from it to the end, itself included."""
    alive, undo = cut_lineage(links.withColumn("w", F.lit(1).cast("long"))), []
    while alive.count() > rest:
        tails = lambda arc, seed=len(undo): F.pmod(F.xxhash64(F.lit(seed), arc), F.lit(2)) == 1
        takes = F.coalesce(tails("next"), F.lit(False)) & F.col("next").isNotNull()
        heads = alive.where(~tails("arc"))
        taking = heads.where(takes).select(F.col("arc").alias("by"), F.col("next").alias("arc"), F.col("w").alias("by_w"))
        row = lambda arc, w, stays: F.struct(arc.alias("arc"), F.col("next").alias("next"), w.alias("w"), F.lit(stays).alias("stays"))
        met = alive.where(tails("arc")).join(taking, "arc", "left").select(F.inline(
            F.when(F.col("by").isNull(), F.array(row(F.col("arc"), F.col("w"), True))).otherwise(
                F.array(row(F.col("by"), F.col("by_w") + F.col("w"), True), row(F.col("arc"), F.col("w"), False)))))
        step = cut_lineage(heads.where(~takes).withColumn("stays", F.lit(True)).union(met))
        undo.append(step.where("NOT stays").drop("stays"))
        alive = step.where("stays").drop("stays")
    ranked = cut_lineage(alive.repartition(1).mapInArrow(_walk, "arc struct<a: bigint, b: bigint, leaves: boolean>, left long"))
    for gone in reversed(undo):
        after = ranked.select(F.col("arc").alias("next"), "left")
        back = gone.join(after, "next", "left").select("arc", (F.col("w") + F.coalesce("left", F.lit(0).cast("long"))).alias("left"))
        ranked = ranked.union(cut_lineage(back))
    return ranked


def subtree_sums(nodes: DataFrame, ranked: DataFrame) -> DataFrame:
    """``key, n_leaves, saved_tokens``: sums over subtrees, from prefix sums at the positions of the arcs."""
    n = ranges(ranked)
    total = ranked.agg(F.max("left")).first()[0] or 1
    own = nodes.select("key", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    arcs = ranked.select(_key(F.col("arc.a"), F.col("arc.b")).alias("key"), F.col("arc.leaves").alias("leaves"), (F.lit(total) - F.col("left")).alias("position"))
    entered = lambda c: F.when(F.col("leaves"), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c)
    chunk = F.floor(F.col("position") * n / total).cast("int").alias("chunk")
    arcs = cut_lineage(arcs.join(own, "key").select("key", "leaves", "position", entered("leaf"), entered("saved"), chunk))
    inside = W.partitionBy("chunk").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    before = arcs.groupBy("chunk").agg(F.sum("leaf").alias("x"), F.sum("saved").alias("y")).select(
        "chunk", *[F.coalesce(F.sum(c).over(earlier), F.lit(0).cast("long")).alias(f"{c}_before") for c in "xy"])
    sums = arcs.select("*", F.sum("leaf").over(inside).alias("x"), F.sum("saved").over(inside).alias("y")).join(F.broadcast(before), "chunk")
    at = lambda c, own: F.sum(F.when(F.col("leaves"), F.col(c) + F.col(f"{c}_before")).otherwise(F.col(own) - F.col(c) - F.col(f"{c}_before")))
    return sums.groupBy("key").agg(at("x", "leaf").alias("n_leaves"), at("y", "saved").alias("saved_tokens"))


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple[int, int, int, list[str]]] = []
        for a, b, conv in zip(*(batch[c].to_pylist() for c in ("a", "b", "conv"))):
            if not rows or rows[-1][:2] != (a, b) or len(rows[-1][3]) == PIECE:
                rows.append((a, b, conv, []))
            rows[-1][3].append(str(conv))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] + [pa.array([",".join(r[3]) for r in rows], pa.string())],
                                         ["a", "b", "conv", "piece"])


def _hash(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([{"a": a, "b": b} for (a, b), _ in rows], pa.struct([("a", pa.int64()), ("b", pa.int64())])),
                                           pa.array([h.hexdigest() for _, h in rows], pa.string())], ["key", "ends_sha256"])

    open_key, digest = None, None
    for batch in batches:
        done = []
        for a, b, piece in zip(*(batch[c].to_pylist() for c in ("a", "b", "piece"))):
            if (a, b) == open_key:
                digest.update(b"," + piece.encode())
                continue
            if open_key is not None:
                done.append((open_key, digest))
            open_key, digest = (a, b), hashlib.sha256(piece.encode())
        yield made(done)
    if open_key is not None:
        yield made([(open_key, digest)])


def end_digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256``: SHA-256 of the ascending numbers, joined by commas.

    A hash must take its text in order, so a node's text goes to one task, as pieces of ``PIECE`` numbers joined beforehand
    by many tasks; it is taken in piece by piece and never held whole.
    """
    parts = [F.col("key.a").alias("a"), F.col("key.b").alias("b"), F.col("conv")]
    ordered = ends.select(*parts).repartitionByRange(ranges(ends), "a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    return (ordered.mapInArrow(_pieces, "a long, b long, conv long, piece string").repartition("a", "b").sortWithinPartitions("a", "b", "conv")
            .mapInArrow(_hash, "key struct<a: bigint, b: bigint>, ends_sha256 string"))


def trie(conversations: DataFrame) -> DataFrame:
    """Every node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    convs, turns = rebuilt(placed_turns(conversations))
    return summed(*nodes_of(convs, turns))


def summed(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    sums = subtree_sums(nodes, list_rank(tour(nodes)))
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    of_parent = join_by_counts(nodes.where("depth > 0").select("key", "parent"), parents, "parent", "n_children").select("key", "parent_conv_id")
    return (nodes.join(of_parent, "key", "left").join(sums, "key").join(end_digests(ends), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))
