"""Neighbours found against brute force, on small tables (all lists read) and on one of many lists."""

import numpy as np
import pytest

from verdikt.llm import ann


def brute(rows, step):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    out = {}
    for q, a in good:
        if q % step:
            continue
        near = sorted((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 12), i) for i, b in good if i != q)
        out[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(near[:5])]
    return out


def answer(df, step, **more):
    got = {}
    for r in ann.neighbours(df, step, **more).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 12)))
    return {q: sorted(v) for q, v in got.items()}


@pytest.mark.parametrize("n", [1, 4, 300])
def test_small_tables_are_exact(spark, monkeypatch, n):
    monkeypatch.setattr(ann, "LIST_TARGET", 40)
    monkeypatch.setattr(ann, "LIST_ROWS", 30)
    rng = np.random.default_rng(n)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=6)]) for k in range(n)]
    if n == 300:
        same = rows[7][1]
        rows += [(1000 + k, same) for k in range(100)] + [(5, rows[5][1])] * 3
        rows += [(2000, None), (2005, [0.0] * 6), (2010, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2015, [float("nan")] * 6), (2020, [float("inf")] + [0.0] * 5),
                 (2025, []), (2030, [1.0, 2.0]), (None, same), (2035, [2 * x for x in same]), (-50, [1e-30] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as vector", "2 as list", "3 as n")
    expected = brute([(i, [None if x is None else float(np.float32(x)) for x in v] if v and len(v) == 6 else None) for i, v in rows], 5)
    assert answer(df, 5) == {q: v for q, v in expected.items() if v}


def test_two_vectors_under_one_id_are_two_rows(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (5, [0.9, 0.1, 0.0]), (5, [0.0, 0.2, 1.0]), (9, [0.0, 0.2, 1.0]), (7, [0.5, 0.5, 0.0])]
    got = answer(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50)
    assert [v for _, v, _ in got[0]] == [5, 7, 5, 9]


def test_bounds_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 8)))], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "LIST_TARGET", 30)
    assert answer(df, 50) == answer(df, 50, first_lists=1 << 20)


def test_empty_table(spark):
    assert ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_recall_over_many_lists(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    vectors = (centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 16))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got, hits = answer(df, 50), 0
    for q in range(0, 6000, 50):
        near = unit @ unit[q]
        near[q] = -2
        hits += len({v for _, v, _ in got[q]} & set(np.argsort(-near)[:5].tolist()))
    assert hits / (5 * 120) >= 0.9


def test_graph_search_finds_the_nearest_lists():
    rng = np.random.default_rng(4)
    index = ann.build_index(rng.normal(size=(4000, 12)), 400)
    sizes = np.bincount((ann._unit(rng.normal(size=(4000, 12))) @ index.centroids.T).argmax(axis=1), minlength=len(index.centroids))
    assert 250 < len(index.centroids) < 900 and sizes.max() < 12 * sizes.mean()
    x = ann._unit(rng.normal(size=(200, 12)))
    ids, away = ann.nearest_lists(index, x)
    best = np.argsort(-(x @ index.centroids.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids.tolist(), best.tolist())]) > 0.95
    assert (np.diff(away, axis=1) >= 0).all()
    chosen = ann.replicas(index, ids, away)
    assert chosen[:, 0].all() and chosen.sum(axis=1).max() <= ann.REPLICAS


def test_a_query_reads_every_list_within_the_ratio():
    rng = np.random.default_rng(6)
    index = ann.build_index(rng.normal(size=(6000, 64)), 500)
    x = ann._unit(rng.normal(size=(50, 64)))
    far = np.sqrt(np.maximum(0, 2 - 2 * x.astype(np.float32) @ index.centroids.T))
    within = far <= ann.PROBE_RATIO * far.min(axis=1, keepdims=True)
    assert np.median(within.sum(axis=1)) > 2 * ann.BEAM
    read = np.zeros(far.shape, bool)
    read[ann.probes(index, x)] = True
    assert (read | ~within).sum() >= 0.999 * read.size and (read | ~within)[within.sum(axis=1) > 2 * ann.BEAM].all()
