"""Collocations of each language, counted by prefix-free parsing.

Texts are cut into pieces and pieces into words. A piece is parsed into chunks: a chunk begins where the piece does and
wherever the next ``LONGEST - 1`` words hash to zero modulo ``TRIGGER``, which their content alone decides, so equal
passages give equal chunks wherever they stand. A chunk runs ``LONGEST - 1`` words into the one after it and owns the
words before that one's start; so each phrase lies whole in the one chunk that owns its first word, and is counted there,
once. Equal chunks are one entry of the dictionary with their number in the parse, and phrases are counted in the entries,
times that number.

Pairs are counted only where both words are frequent, and longer phrases only where all pairs in them are. Tasks know these
through a bitmap of ``FILTER_BITS`` bits, whatever the size of the corpus, which passes all frequent ones and, when it fills,
others too: those cost time and change no count. Pairs, of which most are rare, pass one more bitmap of hashed counts. All
counts that decide are of the words themselves. Counts are summed in a task before they are shuffled.

Edge cases: a null text is empty, a null language is ``und``; texts without words count nothing; repeated rows count each
time; other columns are ignored; an empty table gives an empty result. Texts are taken whole at any length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from verdikt.llm.batches import ranges, slices
from verdikt.llm.skew import join_by_counts
from verdikt.operators.lineage import cut_lineage

LONGEST, LEAST, FIRST, COVERED = 5, 100, 2000, 100
TRIGGER = 32
FILTER_BITS = 1 << 27
#: Bytes of text that a task takes apart at a time. Its arrays of words and keys are many times that, and a worker keeps that memory.
_SLICE = 3 << 20

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64)) for j in range(16)]


class Parsed(NamedTuple):
    """Words of a slice of texts: bytes, with one blank between the words of a piece; codes into the distinct words; where a piece starts."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    hashes: np.ndarray
    first: np.ndarray | None
    owner: np.ndarray


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins; one more end."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def parse(texts: pa.Array) -> Parsed:
    raw, ends = _raw(pc.fill_null(texts.cast(pa.large_string()), ""))
    kind = _KIND[raw]
    opens = np.zeros(len(raw) + 1, bool)
    opens[ends[:-1]] = True
    word = kind == 0
    starts, stops = word.copy(), word.copy()
    starts[1:] &= ~word[:-1] | opens[1:-1]
    stops[:-1] &= ~word[1:] | opens[1:-1]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    owner = np.searchsorted(ends, starts, "right") - 1
    broken = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    first = np.ones(len(starts), bool)
    first[1:] = (broken[1:] != broken[:-1]) | (owner[1:] != owner[:-1])
    lengths = stops - starts
    held = _LOWER[raw[word]]
    tight = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(tight), pa.py_buffer(held)).dictionary_encode()
    data = np.full(len(held) + len(starts), 0x20, np.uint8)
    data[np.arange(len(held)) + np.repeat(np.arange(len(starts)), lengths)] = held
    at = tight + np.arange(len(tight))
    return Parsed(data, at[:-1], at[1:] - 1, words.indices.to_numpy().astype(np.int64), _hashes(words.dictionary), first, owner)


def parse_entries(chunks: pa.Array) -> Parsed:
    """As ``parse``, of entries of the dictionary: words with one blank between them."""
    chunks = chunks.cast(pa.large_string())
    raw, _ = _raw(chunks)
    lists = pc.split_pattern(chunks, " ")
    owner = np.repeat(np.arange(len(chunks)), pc.list_value_length(lists).to_numpy())
    flat = lists.flatten()
    words, lengths = flat.dictionary_encode(), pc.binary_length(flat).to_numpy().astype(np.int64)
    ends = np.cumsum(lengths + 1) - 1 - owner
    return Parsed(raw, ends - lengths, ends, words.indices.to_numpy().astype(np.int64), _hashes(words.dictionary), None, owner)


def texts_of(parsed: Parsed, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Words ``start[i] .. stop[i] - 1``, joined by blanks, for each i."""
    at = parsed.starts[start]
    lengths = parsed.ends[stop - 1] - at
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)])), pa.py_buffer(parsed.data[ranges(at, lengths)]))


def phrase_keys(parsed: Parsed, languages: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the language and of the ``size`` words from each of ``at``."""
    total = languages[at].copy()
    for j in range(size):
        total += parsed.hashes[parsed.codes[at + j]] * _ODD[j]
    total ^= total >> np.uint64(31)
    total *= _ODD[0]
    return total ^ (total >> np.uint64(29))


def cut(parsed: Parsed, longest: int, trigger: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, stop, own``: first word, end and number of owned words of each chunk."""
    n = len(parsed.codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.flatnonzero(parsed.first)
    piece_end = np.repeat(np.append(heads[1:], n), np.diff(np.append(heads, n)))
    fits = np.flatnonzero(np.arange(n) + longest - 1 <= piece_end)
    fits = fits[~parsed.first[fits]]
    opens = parsed.first.copy()
    opens[fits] |= phrase_keys(parsed, np.zeros(n, np.uint64), fits, longest - 1) % np.uint64(trigger) == 0
    start = np.flatnonzero(opens)
    after = np.append(start[1:], n)
    return start, np.minimum(after + longest - 1, piece_end[start]), after - start


def chunks(docs: DataFrame, longest: int = LONGEST, trigger: int = TRIGGER) -> DataFrame:
    """The dictionary ``lang, chunk, own, n`` of the parse of all texts: ``n`` is how often an entry occurs."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _SLICE):
            parsed = parse(part["text"])
            start, stop, own = cut(parsed, longest, trigger)
            found = pa.table([part["lang"].take(pa.array(parsed.owner[start])), texts_of(parsed, start, stop), pa.array(own)], ["lang", "chunk", "own"])
            counted = found.group_by(["lang", "chunk", "own"]).aggregate([([], "count_all")]).combine_chunks()
            for batch in counted.select(["lang", "chunk", "own", "count_all"]).to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([batch[0], batch[1].cast(pa.string()), batch[2], batch[3]], ["lang", "chunk", "own", "n"])

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return cut_lineage(texts.mapInArrow(run, "lang string, chunk string, own long, n long").groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n")))


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _totals(groups: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one member of each distinct group, and the group's weight."""
    order = np.argsort(groups, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(groups[order]) != 0)) if len(order) else order
    return order[heads], np.add.reduceat(weights[order], heads) if len(order) else weights


def _entries(part: pa.RecordBatch):
    """``parsed, language, salt, left, owned``: of each word its entry's language, how many words follow in the entry, itself included, and whether it is owned."""
    parsed = parse_entries(part["chunk"])
    langs = part["lang"].dictionary_encode()
    salt = np.fromiter((xxhash.xxh64_intdigest(x) for x in langs.dictionary.to_pylist()), np.uint64, len(langs.dictionary))
    language = langs.indices.to_numpy()[parsed.owner].astype(np.int64)
    heads = np.searchsorted(parsed.owner, np.arange(part.num_rows + 1))
    place = np.arange(len(parsed.codes))
    return parsed, language, salt[language], heads[parsed.owner + 1] - place, place - heads[parsed.owner] < part["own"].to_numpy()[parsed.owner]


def _counted(part: pa.RecordBatch, parsed: Parsed, language: np.ndarray, at: np.ndarray, size: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """``lang, phrase, n, place`` of each distinct phrase of ``size`` words that begins at one of ``at``."""
    same = language[at]
    for j in range(size):
        same = np.unique(same << 32 | parsed.codes[at + j], return_inverse=True)[1].astype(np.int64)
    one, total = _totals(same, part["n"].to_numpy()[parsed.owner[at]])
    place = at[one]
    return part["lang"].take(pa.array(parsed.owner[place])), texts_of(parsed, place, place + size).cast(pa.string()), total, place


def _bits(bitmap) -> np.ndarray:
    return np.frombuffer(bitmap.value, np.uint8)


def _frequent_words(entries: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "chunk", _SLICE):
            parsed, language, salt, _, owned = _entries(part)
            lang, phrase, n, place = _counted(part, parsed, language, np.flatnonzero(owned), 1)
            yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(n), pa.array(phrase_keys(parsed, salt, place, 1).view(np.int64))], ["lang", "phrase", "n", "key"])

    counts = entries.mapInArrow(run, "lang string, phrase string, n long, key long").groupBy("lang", "phrase")
    return cut_lineage(counts.agg(F.sum("n").alias("n"), F.min("key").alias("key")).where(F.col("n") >= least))


def _pairs(parsed: Parsed, salt: np.ndarray, left: np.ndarray, owned: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``places, keys`` of owned pairs of frequent words."""
    held = _passes(words, phrase_keys(parsed, salt, np.arange(len(salt)), 1))
    at = np.flatnonzero(owned[:-1] & (left[:-1] > 1) & held[:-1] & held[1:])
    return at, phrase_keys(parsed, salt, at, 2)


def _pair_keys(entries: DataFrame, least: int, words) -> DataFrame:
    """``key`` of every frequent pair, and at most a few others: what has one key is counted together."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "chunk", _SLICE):
            parsed, _, salt, left, owned = _entries(part)
            at, keys = _pairs(parsed, salt, left, owned, _bits(words))
            one, total = _totals(keys.view(np.int64), part["n"].to_numpy()[parsed.owner[at]])
            yield pa.RecordBatch.from_arrays([pa.array(keys[one].view(np.int64)), pa.array(total)], ["key", "n"])

    return entries.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _frequent_pairs(entries: DataFrame, least: int, words, pairs) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "chunk", _SLICE):
            parsed, language, salt, left, owned = _entries(part)
            at, keys = _pairs(parsed, salt, left, owned, _bits(words))
            lang, phrase, n, place = _counted(part, parsed, language, at[_passes(_bits(pairs), keys)], 2)
            yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(n), pa.array(phrase_keys(parsed, salt, place, 2).view(np.int64))], ["lang", "phrase", "n", "key"])

    counts = entries.mapInArrow(run, "lang string, phrase string, n long, key long").groupBy("lang", "phrase")
    return cut_lineage(counts.agg(F.sum("n").alias("n"), F.min("key").alias("key")).where(F.col("n") >= least))


def _longer_phrases(entries: DataFrame, least: int, longest: int, pairs) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "chunk", _SLICE):
            parsed, language, salt, left, owned = _entries(part)
            two = np.flatnonzero(left > 1)
            good = np.zeros(len(salt) + longest, bool)
            good[two[_passes(_bits(pairs), phrase_keys(parsed, salt, two, 2))]] = True
            at = np.flatnonzero(owned & good[:len(salt)])
            for size in range(3, longest + 1):
                at = at[good[at + size - 2]]  # a pair that is good lies in one entry, so the phrase does
                lang, phrase, n, _ = _counted(part, parsed, language, at, size)
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(n), pa.array(np.full(len(n), size, np.int32))], ["lang", "phrase", "n", "size"])

    counts = entries.mapInArrow(run, "lang string, phrase string, n long, size int").groupBy("lang", "phrase", "size")
    return cut_lineage(counts.agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def _bitmap(frequent: DataFrame, bits: int):
    """A broadcast bitmap of ``bits`` bits in which each ``key`` of ``frequent`` has its bit; made of pages of 4 KB."""
    place = F.pmod("key", F.lit(bits)) + 1
    pages = frequent.groupBy(F.bitmap_bucket_number(place).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(bits >> 3, np.uint8)
    for page, held in pages:
        start = (page - 1) << 12
        out[start:start + 4096] = np.frombuffer(bytes(held), np.uint8)[:len(out) - start]
    return frequent.sparkSession.sparkContext.broadcast(out.tobytes())


def frequent_phrases(entries: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS) -> DataFrame:
    """``lang, phrase, size, n`` of all phrases of 1 to ``longest`` words that occur ``least`` times or more."""
    words = _frequent_words(entries, least)
    of_words = _bitmap(words, bits)
    pairs = _frequent_pairs(entries, least, of_words, _bitmap(_pair_keys(entries, least, of_words), bits))
    longer = _longer_phrases(entries, least, longest, _bitmap(pairs, bits))
    sized = lambda level, size: level.select("lang", "phrase", F.lit(size).alias("size"), "n")
    return sized(words, 1).union(sized(pairs, 2)).union(longer.select("lang", "phrase", "size", "n"))


def _words(phrase: str = "phrase") -> Column:
    return F.split(phrase, " ")


def _between(start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(_words(), start, size), " ")


def weakest_cuts(candidates: DataFrame, frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of ``candidates(lang, phrase, a, size)``: the cut that scores least, the first of equals."""
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"), "size").select(
        "lang", "phrase", "a", "cut", F.struct("lang", _between(1, F.col("cut")).alias("phrase")).alias("left"),
        F.struct("lang", _between(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("phrase")).alias("right"))
    parts = frequent.select(F.struct("lang", "phrase").alias("part"), "n")

    def with_count(rows: DataFrame, key: str, out: str) -> DataFrame:
        uses = rows.groupBy(F.col(key).alias("part")).agg(F.count("*").alias("uses"))
        right = parts.join(uses, "part").select(F.col("part").alias(key), F.col("n").alias(out), "uses")
        return cut_lineage(join_by_counts(rows, right, key, "uses"))

    cuts = with_count(with_count(cut_lineage(cuts), "left", "l"), "right", "r")
    uses = cuts.groupBy("lang").agg(F.count("*").alias("uses"))
    cuts = join_by_counts(cuts, totals.join(uses, "lang"), "lang", "uses")
    big = {c: f"CAST({c} AS DECIMAL(19, 0))" for c in "anlr"}
    score = F.expr(f"CAST((1000 * {big['a']} * {big['n']}) DIV ({big['l']} * {big['r']}) AS BIGINT)")
    return cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select(
        "lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def not_covered(candidates: DataFrame, share: int = COVERED) -> DataFrame:
    """``candidates`` less those inside a longer one that occurs ``share`` per cent as often or more."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _between(i, m))))
    covers = candidates.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, share: int = COVERED, trigger: int = TRIGGER,
                 bits: int = FILTER_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``first`` phrases of each language of ``docs(text, lang)``."""
    entries = chunks(docs, longest, trigger)
    totals = cut_lineage(entries.groupBy("lang").agg(F.sum(F.col("n") * F.col("own")).alias("n")))
    frequent = frequent_phrases(entries, least, longest, bits)
    candidates = cut_lineage(frequent.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), "size"))
    scored = weakest_cuts(cut_lineage(not_covered(candidates, share)), frequent.where(F.col("size") < longest), totals)
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))).cast("long")
    return scored.withColumn("rank", place).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
