"""Segmentations against the library's own unigram search over the same scores, and against a plain search."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from verdikt.llm import pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "  ", "a", " a", "a ", "a  b   c", "Hello world, it's 1234!", "\n\nx\n y", "naïve café — ß Ñandú", "日本語のテキスト 한국어",
         "🙂🙃 ​ x́", "tab\tand\rcr", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x00\x7f", "Ðþ ꙮ  ꙮꙮ", "internationalization", "<s> </s> <unk> <0x41>"]


def unigram(path):
    """The file's vocabulary as a unigram model: the kind is field 3 of its training settings (2: merges, 1: unigram)."""
    data = bytearray(open(path, "rb").read())

    def varint(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if not data[at - 1] & 128:
                return value, at

    def fields(at, end):
        while at < end:
            key, at = varint(at)
            start = at
            if key & 7 == 0:
                _, at = varint(at)
            elif key & 7 == 2:
                n, start = varint(at)
                at = start + n
            else:
                at += {1: 8, 5: 4}[key & 7]
            yield key >> 3, start, at

    (settings,) = [(a, b) for k, a, b in fields(0, len(data)) if k == 2]
    (kind,) = [a for k, a, _ in fields(*settings) if k == 3]
    assert data[kind] == 2
    data[kind] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(data))


def encode(texts):
    ids, offsets = sp.pieces(PATH).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_equals_the_library_as_unigram():
    library = unigram(PATH)
    rng = random.Random(11)
    letters = "etaoin shrdlu  çñßäé.,\n" + "x"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(300)]
    book = sp.pieces(PATH)
    worth = {k: s for s, k in book.scores.values()}
    total = lambda ids: (sum(k not in worth for k in ids), sum(worth.get(k, 0) for k in ids))
    compared = 0
    for text, ids in zip(texts, encode(texts)):
        theirs = library.encode(text or "")
        if all(c in book.scores for c in (text or "").replace(" ", sp.MARK)):
            assert ids == theirs, text
            compared += 1
        else:  # after a character in no piece the library's 32-bit sums are too coarse to tell the rest apart
            assert total(ids)[0] == total(theirs)[0] and total(ids)[1] >= total(theirs)[1], text
    assert compared > 50


def test_equals_a_plain_search():
    book = sp.pieces(PATH)
    rng = random.Random(12)
    for word in {sp.MARK + "".join(rng.choices("thernias", k=rng.randint(1, 9))) for _ in range(60)}:
        def best(at):
            if at == len(word):
                return 0.0
            return max([book.worst + best(at + 1)] + [book.scores[word[at:e]][0] + best(e) for e in range(at + 1, len(word) + 1) if word[at:e] in book.scores])
        ids = book.segment([word])[word]
        assert sum(book.scores[p][0] for k in ids for p in [next(p for p, v in book.scores.items() if v[1] == k)]) == best(0)


def test_decoding_gives_texts_back():
    book = sp.pieces(PATH)
    ids, offsets = book.encode(pa.array(TEXTS, pa.string()))
    assert book.decode(ids, offsets) == [t or "" for t in TEXTS]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert book.decode(ids, offsets) == [library.decode(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]


def test_words_are_shared_not_mixed():
    rng = random.Random(13)
    words = [sp.MARK + "".join(rng.choices("ab", k=rng.randint(0, 12))) for _ in range(400)]
    book = sp.pieces(PATH)
    together = book.segment(list(dict.fromkeys(words)))
    assert all(together[w] == book.segment([w])[w] for w in words)


def test_forgetting_changes_nothing(monkeypatch):
    whole = encode(TEXTS)
    monkeypatch.setattr(sp, "REMEMBERED", 3)
    assert [encode([t])[0] for t in TEXTS] == whole == encode(TEXTS)


def test_frames(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "a"), (3, "a"), (None, "b"), (50, f"x{sp.MARK}y"), (51, "long word " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as exact", "2 as other")
    got = sp.round_trip(df, PATH).collect()
    assert sorted(((r.doc_id, r.text, r.n_tokens, r.ids_crc32, r.exact, r.other) for r in got), key=str) == sorted(
        ((d, t, len(i), zlib.crc32(np.array(i, "<i4").tobytes()), d != 50, 2) for (d, t), i in zip(rows, encode([t for _, t in rows]))), key=str)
    coded = sp.encode(df, PATH)
    assert {r.doc_id: r.text for r in sp.decode(coded, PATH).where("doc_id < 50").collect()} == {d: t or "" for d, t in rows if d is not None and d < 50}
    assert sp.round_trip(df.limit(0), PATH).collect() == []
    assert sp.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), PATH).collect() == [(None, None), ([], "")]
