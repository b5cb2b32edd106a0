"""Nearest neighbours by cosine through balanced posting lists.

Centroids come from a balanced tree of k-means splits over a bounded sample. Every vector goes to the list of its nearest
centroid, and boundary vectors to further lists that are nearly as near and not behind a list already chosen. Centroids
are found by best-first search in a neighbour graph held in memory. A query is due to read all lists whose centroids are at
most ``PROBE_RATIO`` times as far as the nearest, however many, and compares itself with all they hold, in double precision.
It reads its ``FIRST_LISTS`` nearest lists first. The score of its last place then is a bound: of the others it skips those
whose radius tells that they hold nothing nearer (triangle inequality), and the rest answer only with what reaches the bound.
So answers follow the number of queries, and nothing is lost.

Equal vectors are indexed once, with their smallest ids: more than ``K + 1`` of them cannot be among anyone's nearest.
A list over ``LIST_ROWS`` is read in parts by as many tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from verdikt.llm.skew import join_by_counts
from verdikt.operators.lineage import cut_lineage

K, QUERY_STEP = 5, 50
#: Vectors a centroid, most centroids (which bounds the index that tasks hold), and vectors sampled for each centroid.
LIST_TARGET, MOST_CENTROIDS, SAMPLED = 128, 1 << 16, 16
LIST_ROWS = 20_000
REPLICAS, REPLICA_RATIO = 4, 1.15
PROBE_RATIO, LEAST_LISTS, FIRST_LISTS = 1.25, 12, 3
#: Most bytes of the sample that the index is fitted on.
SAMPLE_BYTES = 256 << 20
DEGREE, BEAM, SEED = 16, 64, 29


class Index(NamedTuple):
    centroids: np.ndarray   # unit vectors, float32
    graph: np.ndarray       # DEGREE neighbours of each
    entries: np.ndarray     # where searches begin


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    # By the largest component first: squares of very large or small numbers leave the range.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _split(points: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Cluster of each point after some rounds of spherical k-means."""
    centres = points[rng.choice(len(points), parts, replace=False)]
    for _ in range(8):
        near = (points @ centres.T).argmax(axis=1)
        total = np.zeros((parts, points.shape[1]), np.float32)
        np.add.at(total, near, points)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, total / np.maximum(size, 1e-12), points[rng.choice(len(points), parts)])
    return (points @ centres.T).argmax(axis=1)


def build_index(sample: np.ndarray, lists: int) -> Index:
    """Splits the sample until no leaf has half as many points again as its share; leaves' means are the centroids."""
    rng = np.random.default_rng(SEED)
    points = np.concatenate([_unit(sample[a:a + 65536]).astype(np.float32) for a in range(0, len(sample), 65536)])
    share, todo, centres = max(1.0, len(points) / lists), [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        parts = min(16, int(np.ceil(len(rows) / share)))
        if len(rows) > 1.5 * share and parts > 1:
            near = _split(points[rows], parts, rng)
            leaves = [rows[near == k] for k in range(parts)]
            if max(map(len, leaves)) < len(rows):
                todo += [x for x in leaves if len(x)]
                continue
        mean = points[rows].mean(axis=0)
        centres.append(mean / max(np.linalg.norm(mean), 1e-12) if np.linalg.norm(mean) > 1e-6 else points[rows[0]])
    centroids = np.stack(centres).astype(np.float32)
    n = len(centroids)
    graph = np.empty((n, min(DEGREE, n)), np.int32)
    for a in range(0, n, 1024):
        near = centroids[a:a + 1024] @ centroids.T
        graph[a:a + 1024] = np.argsort(-near, axis=1, kind="stable")[:, :graph.shape[1]]
    if n > DEGREE:  # some far links keep the graph in one piece
        graph[:, -3:] = rng.integers(0, n, (n, 3))
    return Index(centroids, graph, rng.permutation(n)[:BEAM].astype(np.int32))


def nearest_lists(index: Index, units: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """``lists, distances``, nearest first, for each unit vector; unused places have distance infinity.

    Best-first search of all rows in step: each expands the nearest centroid it has not, until its beam has none left.
    """
    x, c = units.astype(np.float32), index.centroids
    beam = min(beam, len(c))
    far = lambda rows, ids: np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bkd,bd->bk", c[ids], x[rows])))
    everyone = np.arange(len(x))
    ids = np.broadcast_to(index.entries, (len(x), len(index.entries)))
    away = np.sqrt(np.maximum(0, 2 - 2 * x @ c[index.entries].T))
    order = np.argsort(away, axis=1, kind="stable")[:, :beam]
    ids, away = np.take_along_axis(ids, order, 1).astype(np.int32), np.take_along_axis(away, order, 1)
    if ids.shape[1] < beam:
        pad = beam - ids.shape[1]
        ids, away = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(away, ((0, 0), (0, pad)), constant_values=np.inf)
    seen = ~np.isfinite(away)
    while len(open_rows := everyone[~seen.all(axis=1)]):
        at = np.where(seen[open_rows], np.inf, away[open_rows]).argmin(axis=1)
        seen[open_rows, at] = True
        fresh = index.graph[ids[open_rows, at]]
        known = (fresh[:, :, None] == ids[open_rows][:, None, :]).any(axis=2)
        twice = np.tril(fresh[:, :, None] == fresh[:, None, :], -1).any(axis=2)
        new_away = np.where(known | twice, np.inf, far(open_rows, fresh))
        all_ids = np.concatenate([ids[open_rows], fresh], axis=1)
        all_away = np.concatenate([away[open_rows], new_away], axis=1)
        all_seen = np.concatenate([seen[open_rows], ~np.isfinite(new_away)], axis=1)
        order = np.argsort(all_away, axis=1, kind="stable")[:, :beam]
        ids[open_rows], away[open_rows] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_away, order, 1)
        seen[open_rows] = np.take_along_axis(all_seen, order, 1)
    return ids, away


def replicas(index: Index, ids: np.ndarray, away: np.ndarray) -> np.ndarray:
    """Which of the nearest lists hold a vector: the nearest, and others not much farther that no chosen one shields."""
    chosen = np.zeros(ids.shape, bool)
    chosen[:, 0] = True
    held, count = np.repeat(ids[:, :1], REPLICAS, axis=1), np.ones(len(ids), np.int64)
    for k in range(1, ids.shape[1]):
        rows = np.flatnonzero((away[:, k] <= REPLICA_RATIO * away[:, 0] + 1e-9) & (count < REPLICAS))
        if not len(rows):
            continue
        # Unused places of ``held`` repeat the nearest list, which is asked anyway.
        apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bkd,bd->bk", index.centroids[held[rows]], index.centroids[ids[rows, k]])))
        rows = rows[(apart >= away[rows, k, None]).all(axis=1)]
        chosen[rows, k] = True
        held[rows, count[rows]] = ids[rows, k]
        count[rows] += 1
    return chosen


def ranked_probes(index: Index, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``rows, lists, distances, ranks``: what each query is due to read, all lists within the distance ratio and at least the ``LEAST_LISTS`` nearest.

    Where a beam ends before the ratio does, the query is compared with every centroid.
    """
    ids, away = nearest_lists(index, units)
    wanted = np.isfinite(away) & ((np.arange(ids.shape[1]) < LEAST_LISTS) | (away <= PROBE_RATIO * away[:, :1]))
    wide = np.flatnonzero(wanted[:, -1]) if ids.shape[1] < len(index.centroids) else np.empty(0, np.int64)
    wanted[wide] = False
    rows, at = np.nonzero(wanted)
    out = [(rows, ids[rows, at], away[rows, at], at)]
    for a in range(0, len(wide), 64):
        some = wide[a:a + 64]
        far = np.sqrt(np.maximum(0, 2 - 2 * units[some].astype(np.float32) @ index.centroids.T))
        order = np.argsort(far, axis=1, kind="stable")
        near = np.take_along_axis(far, order, 1)
        rows, at = np.nonzero(near <= PROBE_RATIO * near[:, :1])
        out.append((some[rows], order[rows, at].astype(np.int32), near[rows, at], at))
    return tuple(np.concatenate(x) for x in zip(*out))


def probes(index: Index, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``rows, lists`` of ``ranked_probes``."""
    return ranked_probes(index, units)[:2]


def _homes(index: Index, units: np.ndarray, _: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rows, lists, distances``: the lists that hold each vector."""
    ids, away = nearest_lists(index, units)
    rows, at = np.nonzero(replicas(index, ids, away))
    return rows, ids[rows, at], away[rows, at]


def _first_lists(first: int):
    def choose(index: Index, units: np.ndarray, _: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, lists, away, rank = ranked_probes(index, units)
        kept = rank < first
        return rows[kept], lists[kept], away[kept]
    return choose


def _further_lists(first: int, radii):
    """The lists after the first that may hold something as near as the query's bound."""
    def choose(index: Index, units: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, lists, away, rank = ranked_probes(index, units)
        bound = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(part["bound"].to_numpy(), -1.0)))
        kept = (rank >= first) & (away - radii.value[lists] <= bound[rows] + 2e-3)  # distances are of single precision
        return rows[kept], lists[kept], away[kept]
    return choose


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _place(index_of, choose):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                rows, lists, away = choose(index, _unit(_matrix(part["vector"])), part)
                for b in range(0, len(rows), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(lists[b:b + 8192], pa.int32()), pa.array(away[b:b + 8192], pa.float64()),
                                                      *[part[c].take(pa.array(rows[b:b + 8192])) for c in part.schema.names]],
                                                     ["list", "away", *part.schema.names])
    return run


_FOUND = pa.schema([("qid", pa.int64()), ("gid", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])


def _compare(held: pa.Table, asked: pa.Table) -> pa.Table:
    """Best ``K + 1`` groups of a part of a list for each query sent to it, of those that reach the query's bound."""
    if not held.num_rows or not asked.num_rows:
        return _FOUND.empty_table()
    out = []
    vectors, gids = _unit(_matrix(held["vector"].combine_chunks())), held["gid"].to_numpy()
    queries, qids = _unit(_matrix(asked["vector"].combine_chunks())), asked["qid"].to_numpy()
    ids, bounds = held["ids"].combine_chunks(), asked["bound"].to_numpy() - 1e-12
    low = held["low"].to_numpy()
    for a in range(0, len(queries), block := max(1, 2_000_000 // len(vectors))):
        near = queries[a:a + block] @ vectors.T
        wide = min(len(vectors), 2 * K + 2)
        top = np.argpartition(-near, wide - 1, axis=1)[:, :wide] if wide < len(vectors) else np.broadcast_to(np.arange(len(vectors)), near.shape)
        # Ties at the edge of the selection must not depend on where a vector stands.
        edge = np.take_along_axis(near, top, 1).min(axis=1) - 1e-12
        rows, at = np.nonzero(near >= edge[:, None])
        exact = np.einsum("kd,kd->k", queries[a + rows], vectors[at])
        reach = exact >= bounds[a + rows]
        rows, at, exact = rows[reach], at[reach], exact[reach]
        order = np.lexsort((gids[at], low[at], -exact, rows))
        rows, at, exact = rows[order], at[order], exact[order]
        first = np.searchsorted(rows, np.arange(len(near)))
        kept = np.arange(len(rows)) - first[rows] <= K
        rows, at, exact = rows[kept], at[kept], exact[kept]
        out.append(pa.RecordBatch.from_arrays([pa.array(qids[a + rows]), pa.array(gids[at]), pa.array(exact),
                                               ids.take(pa.array(at)).cast(_FOUND.field("ids").type)], _FOUND.names))
    return pa.Table.from_batches([b.cast(_FOUND) for b in out], _FOUND)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` of rows that take part: an id, and a vector that is not zero and has only finite components.

    All have one length: the commonest, or the greatest of equally common ones.
    """
    at = F.col("vector")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & at.isNotNull() & (F.size(at) > 0)
        & F.forall(at, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(at, lambda v: v != 0))
    common = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("vector") == (common.d if common else 0))


def fit(groups: DataFrame) -> Index | None:
    """Index from ``SAMPLED`` groups for each list wanted, at every size, told by their hash; in one task."""
    count = groups.count()
    if not count:
        return None
    lists = max(1, min(MOST_CENTROIDS, count // LIST_TARGET))
    place = F.xxhash64("gid", "vector")
    width = groups.select(F.size("vector")).first()[0]
    sampled = max(lists, min(lists * SAMPLED, SAMPLE_BYTES // (4 * width)))
    sample = groups.select(place.alias("place"), "vector").where(F.pmod("place", F.lit(count)) < sampled)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, rows = [], []
        for b in batches:
            if b.num_rows:
                places.append(b["place"].to_numpy())
                rows.append(_unit(_matrix(b["vector"])).astype(np.float32))
        if rows:
            # By hash, so that the index does not depend on where rows stand.
            order = np.argsort(np.concatenate(places), kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tuple(build_index(np.concatenate(rows)[order], lists)))])], ["index"])

    return Index(*pickle.loads((sample if count > LIST_TARGET else groups.select(place.alias("place"), "vector")).repartition(1)
                               .mapInArrow(build, "index binary").first()[0]))


def neighbours(vectors: DataFrame, step: int = QUERY_STEP, first_lists: int = FIRST_LISTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``K`` nearest rows found, by cosine.

    Queries are rows whose id is divisible by ``step``. Nearest first, ties to the smaller id. A query's own id is no
    answer; a row repeated with the same id counts once, and of different vectors under one id each is a row. Rows that
    cannot take part neither ask nor answer; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = valid_vectors(vectors)
    nth = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    groups = cut_lineage(rows.withColumn("nth", nth).where(F.col("nth") <= K + 1).groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
                         .select(F.xxhash64(F.col("ids")[0], "vector").alias("gid"), F.col("ids")[0].alias("low"), "vector", "ids"))
    asking = rows.where(F.col("vec_id") % step == 0)
    index = fit(groups)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)
    queries = cut_lineage(asking.groupBy("vector").agg(F.min("vec_id").alias("qid"), F.count("*").alias("n")))
    # Two different vectors may share an id, so a query is told by its vector's hash too.
    queries = queries.withColumn("qid", F.xxhash64("qid", "vector"))
    postings = cut_lineage(groups.mapInArrow(_place(shared, _homes), "list int, away double, gid long, low long, vector array<double>, ids array<long>"))
    parts = cut_lineage(postings.groupBy("list").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts"), F.max("away").alias("radius")))
    radii = np.zeros(len(index.centroids))
    for row in parts.collect():  # a row a list, and no more lists than centroids
        radii[row.list] = row.radius
    radii = spark.sparkContext.broadcast(radii)
    lists = postings.drop("away").join(F.broadcast(parts.select("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int")).drop("parts")

    def read(asked: DataFrame, choose) -> DataFrame:
        sent = (asked.mapInArrow(_place(shared, choose), "list int, away double, qid long, vector array<double>, bound double").drop("away")
                .join(F.broadcast(parts.select("list", "parts")), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
        return cut_lineage(lists.groupBy("list", "part").cogroup(sent.groupBy("list", "part"))
                           .applyInArrow(_compare, "qid long, gid long, score double, ids array<long>"))

    first = read(queries.select("qid", "vector", F.lit(-2.0).alias("bound")), _first_lists(first_lists))
    last = (first.groupBy("qid", "gid").agg(F.max("score").alias("score"))
            .withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("k") == K + 1).select("qid", F.col("score").alias("bound")))
    bounded = queries.join(last, "qid", "left").select("qid", "vector", F.coalesce("bound", F.lit(-2.0)).alias("bound"))
    found = first.union(read(bounded, _further_lists(first_lists, radii)))
    best = (found.groupBy("qid", "gid").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
            .select("qid", "score", F.explode("ids").alias("vec_id"))
            .withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("k") <= K + 1)
            .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("near")))
    answers = queries.join(best, "qid").select("vector", "n", "near")
    own = F.filter("near", lambda r: r.vec_id != F.col("query_id"))
    return (join_by_counts(asking.select(F.col("vec_id").alias("query_id"), "vector").distinct(), answers, "vector", "n")
            .select("query_id", F.posexplode(F.slice(own, 1, K)).alias("at", "r"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score")))
