"""Held-out accuracy of the learned models, and their defined answers at the edges."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from verdikt.llm import batches, langid, quality

WORDS = {"aa": "abda bada dabba abad", "bb": "kolo loko kook lolok", "cc": "imin nimi minni inim"}


def held(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    return [(k, lang, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(3, 40)))) for k in range(300) for lang in [rng.choice(list(WORDS))]]


def test_split_words_and_hashes_agree_with_python():
    given = ["a b  a", "", None, "\t", " x\ny\x0bz ", "é a\xa0b", "w" * 9000]
    offsets, codes, words = batches.split_words(pa.array(given))
    words = words.to_pylist()
    got = [[words[c] for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])]
    assert got == [["a", "b", "a"], [], [], [], ["x", "y", "z"], ["é", "a\xa0b"], ["w" * 9000]]
    one, _ = batches.word_ngrams(pa.array(["abc", "zz", "abc"]), (3,), 1 << 20)
    ids, owners = batches.word_ngrams(pa.array(["abc"]), (3,), 1 << 20)
    assert one[:3].tolist() == ids.tolist() == one[-3:].tolist() and len(one) == 3 + 2 + 3
    assert batches.word_ids(pa.array(["ab", "ba", "ab"]), 1 << 30)[0] == batches.word_ids(pa.array(["ab"]), 1 << 30)[0]


def test_slices_bound_bytes_and_keep_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["x" * k for k in (5, 50, 1, 1, 1)] + [None] * 3)})
    parts = list(batches.slices([batch], "text", 6))
    assert [p.num_rows for p in parts] == [1, 1, 6]


def test_quality(spark, texts):
    rng = random.Random(10)
    rows = [(k, t if k % 3 else " ".join([t.split()[0]] * rng.randint(4, 30))) for k, _, t in texts] + [(9000, None), (9001, ""), (None, "abda"), (5, "abda " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as label", "2 as keep")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k, *_ in texts if k != 5] + [(None, 1), (7, None), (8, 9)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(rows) and {"keep", "label"} <= set(got[0].asDict())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    right = [(r.score > 0.5) == (r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 300 and held(r.doc_id, 5) == 0 and r.doc_id != 5]
    assert np.mean(right) > 0.95
    again = quality.score(docs, quality.fit(docs.repartition(3), labels)).collect()
    assert {(r.doc_id, r.text): r.score for r in again} == {(r.doc_id, r.text): r.score for r in got}


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    table = quality.fit(docs, none)
    assert [(r.score, r.predicted) for r in quality.score(docs, table).collect()] == [(0.5, 1)] * 2
    assert quality.score(docs.limit(0), table).collect() == []


def test_language(spark, texts):
    rows = [(k, t, lang) for k, lang, t in texts] + [(9000, None, "aa"), (9001, "", "bb"), (9002, "123 .", "cc"), (None, "abda", "aa"), (4, "kolo " * 4000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "0 as h", "1 as ids")
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == r.lang for r in got if r.lang and r.doc_id is not None and r.doc_id < 300 and held(r.doc_id, 3) == 1]
    assert np.mean(right) > 0.97
    assert all(r.lang_pred == "und" and r.score == 0 and r.ambiguous for r in got if r.doc_id in (9000, 9001, 9002))
    assert {r.lang_pred for r in got} == {"aa", "bb", "cc", "und"}


def test_language_with_one_or_none_known(spark):
    docs = spark.createDataFrame([(k, "abda", "aa") for k in range(9)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs)).collect()} == {("aa", 1.0)}
    unknown = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in langid.predict(unknown, langid.fit(unknown)).collect()} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).collect() == []


@pytest.mark.parametrize("count", [1, 2, 3, 5, 6, 7, 12, 40])
def test_codewords_differ(count):
    words = langid.codewords(count)
    assert words.shape[0] == count and len({tuple(w) for w in words}) == count if count > 1 else words.shape == (1, 0)
    if count >= 4:
        apart = min((words[a] != words[b]).sum() for a in range(count) for b in range(a))
        assert apart >= 3


def test_decoding_corrects_a_wrong_bit():
    codes = langid.codewords(4)
    model = langid.Model(list("abcd"), codes, np.zeros((1, 7)), np.zeros(7), np.ones(7))
    outputs = 4.0 * codes[[0, 1, 2, 3]]
    outputs[:, 2] *= -1
    best, share, lead = langid.decode(model, outputs)
    assert best.tolist() == [0, 1, 2, 3] and (lead > 0).all()
    _, share, lead = langid.decode(model, np.zeros((1, 7)))
    assert lead[0] < langid.AMBIGUOUS and abs(share[0] - 0.25) < 1e-9
