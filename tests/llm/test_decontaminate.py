"""Leaks found against a scan of every window by longest common subsequence; clean documents stay."""

import random

import numpy as np
import pytest

from verdikt.llm import decontaminate as dc


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def brute(docs, items):
    """Pairs whose passage is SURE in some window of its length and half again."""
    out = set()
    for d, text in docs:
        words = dc.plain_words(text)
        for i, passage in items:
            p = dc.plain_words(passage)
            if p and any(lcs(p, words[k:k + len(p) * 3 // 2]) >= dc.SURE * len(p) for k in range(len(words))):
                out.add((d, i))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    common, rare = [f"the{k}" for k in range(20)], [f"w{k}x" for k in range(3000)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]
    items = [(k, " ".join(prose(rng.randint(12, 45)))) for k in range(25)]
    docs = []
    for k in range(120):
        words = prose(rng.randint(20, 400))
        if k % 3 == 0:
            passage = items[rng.randrange(25)][1].split()
            kind = k % 4
            if kind == 1:     # some words replaced
                passage = [rng.choice(rare) if rng.random() < 0.12 else w for w in passage]
            elif kind == 2:   # other case and marks
                passage = [f"«{w.upper()}»," for w in passage]
            at = rng.randrange(len(words))
            words[at:at] = passage
        docs.append((k, " ".join(words)))
    return docs, items


def found(spark, docs, items, columns="item_id long, text string"):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as digest", "2 as item_id", "3 as words")
    return {(r.doc_id, r.item_id) for r in dc.leaks(df, spark.createDataFrame(items, columns)).collect()}


def test_matches_brute_force(spark, corpus):
    docs, items = corpus
    truth = brute(docs, items)
    assert len(truth) > 35
    got = found(spark, docs, items)
    assert truth <= got and len(got - truth) <= 1
    kept = {r.doc_id for r in dc.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_blocks_of_items_give_the_same(spark, corpus, monkeypatch):
    docs, items = corpus
    whole = found(spark, docs[:40], items)
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 9)
    assert found(spark, docs[:40], items) == whole


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu"
    docs = [(1, item), (1, item), (2, None), (3, ""), (None, "x " + item), (4, "... | -- !"), (5, "y " * 30_000 + item + " y" * 100), (6, "alpha mu"), (7, item + " " + item)]
    assert found(spark, docs, [(9, item), (10, None), (None, item), (11, " ... "), (12, "never seen here at all")]) == {(1, 9), (None, 9), (5, 9), (7, 9)}
    assert found(spark, docs, []) == set() and found(spark, [], [(9, item)]) == set()


def test_answer_settles_a_loose_paraphrase(spark):
    item = [f"q{k}" for k in range(20)]
    loose = [w if k % 3 else f"other{k}" for k, w in enumerate(item)]          # 13 of 20 in order
    rng = random.Random(1)
    noise = [(100 + k, " ".join(f"n{rng.randrange(500)}" for _ in range(50))) for k in range(30)]
    rows = [(1, " ".join(loose) + " forty two"), (2, " ".join(loose) + " seven")]
    assert found(spark, rows + noise, [(9, " ".join(item), "Forty two.")], "item_id long, text string, answer string") == {(1, 9)}


def test_bit_parallel_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(8) for _ in range(rng.randint(1, 60))]
        b = [rng.randrange(-1, 9) for _ in range(rng.randint(0, 90))]
        assert dc.common_subsequence(dc._masks(a), len(a), b) == lcs(a, b)


def test_randomised_basis_spans_the_leading_vectors(spark, monkeypatch):
    monkeypatch.setattr(dc, "RANK", 24)
    rng = np.random.default_rng(3)
    topics = [rng.permutation(60)[:8] for _ in range(6)]
    items = [dc.Passage(k, rng.choice(topics[k % 6], 12).tolist(), []) for k in range(40)]
    rows = [np.array(p.words, np.int32) for p in items]
    coded = spark.createDataFrame([(k, k, bytearray(w.tobytes())) for k, w in enumerate(rows)], "doc_id long, digest long, ids binary")
    idf = rng.uniform(1, 3, 60)
    matrix = np.zeros((40, 60))
    for k, w in enumerate(rows):
        np.add.at(matrix[k], w, idf[w])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    values = np.linalg.svd(matrix, compute_uv=False)
    basis = dc._latent_basis(coded, items, idf)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-4)
    assert np.linalg.norm(matrix @ basis) ** 2 > 0.97 * (values[:24] ** 2).sum()
