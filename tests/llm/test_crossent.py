"""Scores against counting everything in one place."""

import math
import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verdikt.llm import crossent

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    tk = Tokenizer.from_file(PATH)
    size = tk.get_vocab_size()
    texts = [[size, *tk.encode(t or "", add_special_tokens=False).ids, size] for _, t, _ in rows]
    models = []
    for chosen in ([t for t, r in zip(texts, rows) if r[2]], texts):
        pairs = Counter(p for t in chosen for p in zip(t, t[1:]))
        first, second = Counter(), Counter()
        for (a, b), n in pairs.items():
            first[a] += n
            second[b] += n
        models.append((pairs, first, second, sum(second.values())))
    out = []
    for (d, _, _), t in zip(rows, texts):
        loss = []
        for pairs, first, second, n in models:
            p = [(pairs[a, b] + crossent.PRIOR * (second[b] + 1) / (n + size + 1)) / (first[a] + crossent.PRIOR) for a, b in zip(t, t[1:])]
            loss.append(-sum(map(math.log, p)) / len(p))
        out.append((d, len(t) - 2, loss[0], loss[1]))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, target boolean").selectExpr("*", "1 as ids", "'x' as score", "2 as chunk").repartition(3)
    key = lambda r: (r[0] is None, r[0], r[1], round(r[2], 9))
    got = sorted([(r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in crossent.score(df, PATH).collect()], key=key)
    expected = sorted(brute(rows), key=key)
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g[:2] == e[:2] and g[2:] == pytest.approx(e[2:], abs=1e-9)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(crossent, "SLICE_BYTES", 300)
    monkeypatch.setattr(crossent, "PART_ROWS", 100)
    rng = random.Random(15)
    words = ["alpha", "beta", "gamma", "Delta", "the", "of", "éte", "x1"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.random() < 0.3) for k in range(80)]
    rows += [(3, "alpha", None), (3, "alpha", None), (None, "beta the", True), (90, None, False), (91, "the of " * 3000, True)]
    check(spark, rows)


def test_without_target_and_without_rows(spark):
    check(spark, [(1, "a b", False), (2, None, None)])
    assert crossent.score(spark.createDataFrame([], "doc_id long, text string, target boolean"), PATH).collect() == []


def test_target_texts_score_lower(spark):
    rng = random.Random(16)
    one, two = "red green blue cyan".split(), "dog cat cow hen".split()
    docs = spark.createDataFrame([(k, " ".join(rng.choices(one if k % 2 else two, k=20))) for k in range(60)] + [(None, "dog")], "doc_id long, text string")
    marks = spark.createDataFrame([(k,) for k in range(1, 30, 2)] * 2 + [(None,)], "doc_id long")
    flagged = crossent.with_target(docs, marks)
    assert flagged.count() == 61 and flagged.where("target").count() == 15
    got = {r.doc_id: r.score for r in crossent.score(flagged, PATH).collect()}
    assert max(got[k] for k in range(31, 60, 2)) < min(got[k] for k in range(0, 60, 2))
