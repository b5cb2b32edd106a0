"""Collocations against plain counting, and the parse that counts every phrase once."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from verdikt.llm import collocations as C
from verdikt.llm.batches import slices

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, chunk string, own int, key string"


def plain_words(text):
    return [re.findall("[^ \t]+", piece) for piece in re.split("[.,;:!?\n-\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]


def plain(docs, least, longest=5, first=2000, share=100):
    out = set()
    for lang in {row[1] or "und" for row in docs}:
        pieces = [p for text, own in docs if (own or "und") == lang for p in plain_words(text)]
        n, f = sum(map(len, pieces)), Counter(tuple(p[i:i + k]) for p in pieces for k in range(1, longest + 1) for i in range(len(p) - k + 1))
        candidates, rows = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, []
        for p, a in candidates.items():
            if any(p == q[i:i + len(p)] and 100 * b >= share * a for q, b in candidates.items() if len(q) > len(p) for i in range(len(q) - len(p) + 1)):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[p[:k]], f[p[k:]], n, score))
        out |= {(lang, rank, *row[3:]) for rank, row in enumerate(sorted(rows)[:first], 1)}
    return out


def made(seed, size=60):
    r = random.Random(seed)
    words = ["a", "B", "the", "É", "of", "ab", "x\x01", "日本"]
    passage = " ".join(r.choices(words, k=40))
    docs = [("".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " \r"]) for _ in range(r.randint(0, 80))) + (passage if r.random() < 0.5 else ""),
             r.choice(["en", "de", None])) for _ in range(size)]
    return docs + docs[:4] + [(None, "en"), ("", None), (" .,;", "fr"), ("w " * 30_000, "xx")]


def frame(spark, docs):
    return spark.createDataFrame([(k, text, lang, "p", 1, "c", 2, "z") for k, (text, lang) in enumerate(docs)], SCHEMA)


@pytest.mark.parametrize("seed, least, trigger, bits, share", [(1, 8, 3, 1 << 27, 100), (2, 3, 1, 1 << 15, 60)])
def test_results_are_those_of_plain_counting(spark, seed, least, trigger, bits, share):
    docs = made(seed)
    got = C.collocations(frame(spark, docs), least=least, trigger=trigger, bits=bits, share=share).collect()
    assert {tuple(r) for r in got} == plain(docs, least, share=share) and len(got) == len({tuple(r) for r in got})


def test_the_first_of_each_language_only(spark):
    docs = made(5)
    got = C.collocations(frame(spark, docs), least=4, first=7)
    assert {tuple(r) for r in got.collect()} == plain(docs, 4, first=7)


def test_every_word_is_owned_by_one_chunk_and_equal_passages_give_equal_chunks():
    r = random.Random(4)
    passage = [r.choice("abcdefgh") for _ in range(300)]
    texts = [" ".join([r.choice("xyz") for _ in range(k)] + passage) for k in (0, 5, 11)]
    parsed = C.parse(pa.array(texts))
    start, stop, own = C.cut(parsed, 5, 8)
    assert own.sum() == len(parsed.codes) == 916 and np.all(stop - start <= own + 4)
    chunks = C.texts_of(parsed, start, stop).to_pylist()
    whose = parsed.owner[start]
    sets = [{c for c, w in zip(chunks, whose) if w == k} for k in range(3)]
    assert len(sets[0] & sets[1] & sets[2]) > 0.9 * len(sets[0])


def test_scores_past_64_bits_are_exact(spark):
    big = [("en", "a b", 3 * 10**15 + 7, 2)]
    parts = spark.createDataFrame([("en", "a", 4 * 10**15 + 1, 1), ("en", "b", 5 * 10**15 + 3, 1)], "lang string, phrase string, n long, size int")
    candidates = spark.createDataFrame(big, "lang string, phrase string, a long, size int")
    totals = spark.createDataFrame([("en", 9 * 10**17 + 11)], "lang string, n long")
    row = C.weakest_cuts(candidates, parts, totals).first()
    assert row.score == 1000 * (3 * 10**15 + 7) * (9 * 10**17 + 11) // ((4 * 10**15 + 1) * (5 * 10**15 + 3))


def test_no_documents(spark):
    assert C.collocations(frame(spark, [])).collect() == []
    assert C.collocations(frame(spark, [(None, None)])).collect() == []


def test_a_task_takes_apart_so_much_text_that_its_arrays_stay_small():
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(20_000)])
    chunks = [" ".join(words[rng.integers(0, len(words), 40)]) for _ in range(50_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(chunks)), pa.array(chunks), pa.array([36] * len(chunks)), pa.array([1] * len(chunks))], ["lang", "chunk", "own", "n"])
    tracemalloc.start()
    for part in slices([batch], "chunk", C._SLICE):
        parsed, language, salt, left, owned = C._entries(part)
        C._counted(part, parsed, language, np.flatnonzero(owned & (left > 1)), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
