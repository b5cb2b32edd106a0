"""Arrow batches in tasks: slices of bounded bytes, and whole texts as codes of their distinct words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 8 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``offsets, codes, words``: text i has the words ``words[codes[offsets[i]:offsets[i + 1]]]``.

    Words are what ASCII white space separates; a null text has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets -= offsets[0]
    codes, words = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        kept = codes != empty
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        codes = codes[kept]
    return offsets, codes, words


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run ``values[offsets[i]:offsets[i + 1]]``; empty runs give zero."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def word_ngrams(words: pa.Array, orders: Iterable[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of marked words: ``buckets`` ids and the word each belongs to.

    A word is taken with a mark at both ends. All words are hashed together, as windows over their code points.
    """
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(("\x02" + "\x02".join(words.to_pylist()) + "\x02").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    ids, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for order in orders:
        if len(points) < order:
            continue
        mixed = np.full(len(points) - order + 1, order * 2654435761 & 0xFFFFFFFF, np.uint32)
        for k in range(order):
            mixed = (mixed ^ points[k:len(points) - order + 1 + k]) * np.uint32(0x01000193)
            mixed ^= mixed >> np.uint32(15)
        counts = np.maximum(lengths + 2 - order + 1, 0)
        ids.append((mixed[ranges(starts, counts)] % np.uint32(buckets)).astype(np.int64))
        owners.append(np.repeat(np.arange(len(words)), counts))
    return np.concatenate(ids), np.concatenate(owners)


def word_ids(words: pa.Array, buckets: int) -> np.ndarray:
    """Hashed id of each whole word."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    place = np.arange(len(points), dtype=np.uint64) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.uint64)
    terms = (points + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
    terms ^= terms >> np.uint64(29)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms * np.uint64(0xBF58476D1CE4E5B9))])
    ends = np.cumsum(lengths)
    mixed = total[ends] - total[ends - lengths]
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(buckets)).astype(np.int64)


def with_text_columns(docs: DataFrame, make: Callable[[pa.Array], list[pa.Array]], fields: str) -> DataFrame:
    """``docs`` with the columns ``fields`` (DDL), which ``make`` gives for a slice of ``text``.

    Columns of ``docs`` with those names are replaced; all others stay.
    """
    new = StructType.fromDDL(fields)
    kept = docs.drop(*new.names).withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES // 4):
            yield pa.RecordBatch.from_arrays([*part.columns, *make(part["text"])], [*part.schema.names, *new.names])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *new.fields]))
