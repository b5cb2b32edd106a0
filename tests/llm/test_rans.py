"""Coded ids come back, segment by segment and from any checkpoint; ids equal the tokenizer's own."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from verdikt.llm import rans, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", None, "it's we'll DON'T", "<|endoftext|> <|startoftext|>x", "Ça éÉ ßẞ İstanbul ﬁ x́ é", "a1b22c3.4,5", "a b c\x1cd\x85e",
       "日本語 текст ελλάς", "!!?? ...", "x" * 3000, "Ñjaosñ, ciónrr.\nRaque", "ªº µ × ÷ _a_", "\x00\x01 a​b", "🙂🙂 a🙂b", "Æther Œuvre ÿŸ"]


def test_word_tokenizer_equals_the_library():
    whole = Tokenizer.from_file(PATH)
    ids, counts = tokens.word_tokenizer(PATH).encode(pa.array(ODD), 1)
    at = 0
    for text, n in zip(ODD, counts):
        assert ids[at:at + n].tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 1], text
        at += n
    assert at == len(ids)


@pytest.mark.parametrize("size", [0, 1, 1023, 1024, 70_000, 300_000])
def test_segment_round_trip(size):
    rng = np.random.default_rng(size)
    ids = (rng.pareto(1.0, size) * 20).astype(np.int64).clip(0, 49_407).astype(np.uint32)
    counts = np.diff(np.sort(np.concatenate([[0, size], rng.integers(0, size + 1, 5)])))
    docs = np.arange(len(counts))
    data = rans.encode_segment(docs, docs == 0, counts, ids)
    back = rans.decode_segment(data)
    assert [b.tolist() for b in back] == [docs.tolist(), (docs == 0).astype(int).tolist(), counts.tolist(), ids.tolist()]
    if size > 1000:
        bad = bytearray(data)
        bad[-9] ^= 4
        with pytest.raises(rans.Corrupt):
            rans.decode_segment(bytes(bad))


def test_size_is_near_the_entropy():
    ids = np.random.default_rng(1).geometric(0.01, 500_000).astype(np.uint32)
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8
    assert len(rans.encode_segment(np.array([1]), np.array([0]), np.array([len(ids)]), ids)) < 1.12 * entropy


def test_decoding_from_checkpoints():
    ids = np.random.default_rng(2).integers(0, 500, 200_000)
    symbols, freq = rans.frequency_table(ids)
    wide, start = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    lookup = np.repeat(np.arange(len(symbols)), freq)
    data, marks = rans.encode_block(ids, wide, start)
    step = rans.CHECKPOINT * rans.LANES
    assert len(marks) == 2
    for k in range(2):
        part = rans.decode_block(data, len(ids), marks, wide, start, lookup, k, k + 1)
        assert part.tolist() == ids[k * step:(k + 1) * step].tolist()


def test_more_symbols_than_room():
    ids = np.concatenate([np.arange(49_000), np.zeros(4_000_000, np.int64)])
    symbols, freq = rans.frequency_table(ids)
    assert freq.sum() == 1 << rans.SCALE and freq.min() >= 1 and len(symbols) == 49_000


def test_digests_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rans, "SEGMENT", 2000)
    rng = random.Random(3)
    rows = [(k * 7 % 101, rng.choice(ODD)) for k in range(101)] + [(5, "b a"), (5, "b a"), (5, None), (None, "no id"), (999, "word, " * 9000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as start", "1 as ids", "2 as shard").repartition(5)
    got = sorted(rans.id_digests(df, PATH).collect(), key=lambda r: r.start)
    whole, start = Tokenizer.from_file(PATH), 0
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert len(got) == len(rows)
    for r, (doc_id, text) in zip(got, rows):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_table(spark):
    assert rans.id_digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_a_bounded_memory_forgets_and_gives_the_same_ids():
    import public_tokenizers
    import pyarrow as pa

    from verdikt.llm.tokens import WordTokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [["Plain words, and wörds.", "x" * 5000, "", None, "日本語" * 400], ["and more plain words!", "x" * 5000]] * 2
    small, free = WordTokenizer(path, 2000), WordTokenizer(path)
    for part in texts:
        for one, two in zip(small.encode(pa.array(part), 1), free.encode(pa.array(part), 1)):
            assert one.tolist() == two.tolist()
        assert small.bytes > 2000  # held until the next texts come
    assert len(small.words) < len(free.words)
