"""Token ids in files coded by a static range asymmetric numeral system.

A file is a run of segments. A segment holds whole documents and one frequency table, which all its blocks share:

    "VRNS" | header length, crc32 (u32) | header (JSON) | documents | table | blocks

* documents: doc_id (i64), whether it is null (u8) and number of ids (u32) of each, compressed;
* table: symbols and frequencies (u32), compressed; frequencies sum to ``1 << SCALE``;
* block: ``BLOCK`` ids (the last has fewer). Its ids are dealt in turn to ``LANES`` coders whose 32-bit words share one
  stream, so a step codes one id in every lane at once. Blocks are independent, and a block notes the states and the
  place in the stream at every ``CHECKPOINT`` steps, so decoding may begin at any of them. The header has the crc32 of
  each block's bytes and of the ids between checkpoints.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from verdikt.llm import store
from verdikt.llm.batches import SLICE_BYTES, slices
from verdikt.llm.tokens import word_tokenizer
from verdikt.operators.lineage import cut_lineage

MAGIC = b"VRNS"
SCALE, LANES, BLOCK, CHECKPOINT, SEGMENT = 20, 1024, 1 << 18, 128, 1 << 21
MOST_TASKS = 20_000
#: Bytes of tokenized words that a worker remembers.
REMEMBERED_BYTES = 224 << 20

_FLOOR, _WORD = np.uint64(1 << 31), np.uint64(32)
_SHIFT, _MASK = np.uint64(SCALE), np.uint64((1 << SCALE) - 1)


class Corrupt(ValueError):
    """Bytes that are not what the writer left."""


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``symbols, frequencies``: every symbol that occurs, at least 1 each, in sum ``1 << SCALE``."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    if len(symbols) > 1 << SCALE:
        raise ValueError(f"a segment has {len(symbols)} distinct ids; the scale allows {1 << SCALE}")
    counts = counts[symbols]
    freq = np.maximum(1, counts * (1 << SCALE) // max(1, counts.sum()))
    spare = (1 << SCALE) - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    while spare and len(symbols):
        if spare > 0:
            freq[order[0]] += spare
            spare = 0
        else:  # take from the most frequent what the least frequent were lent
            room = np.minimum(freq[order] - 1, -spare)
            taken = np.minimum(room, np.maximum(0, -spare - (np.cumsum(room) - room)))
            freq[order] -= taken
            spare += int(taken.sum())
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def encode_block(ranks: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[bytes, list[int]]:
    """Bytes of a block of symbol ranks and the stream place of each checkpoint, first to last."""
    steps = -(-len(ranks) // LANES)
    state = np.full(LANES, _FLOOR, np.uint64)
    words: list[np.ndarray] = []
    written, marks = 0, []
    for step in range(steps - 1, -1, -1):
        part = ranks[step * LANES:(step + 1) * LANES]
        f, x = freq[part], state[:len(part)]
        full = x >= f << np.uint64(63 - SCALE)
        if full.any():
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            written += len(words[-1])
            x = np.where(full, x >> _WORD, x)
        high = x // f
        state[:len(part)] = (high << _SHIFT) + (x - high * f) + start[part]
        if step % CHECKPOINT == 0:
            marks.append((written, state.copy()))
    marks.reverse()
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return b"".join(m[1].tobytes() for m in marks) + stream.tobytes(), [written - m[0] for m in marks]


def decode_block(data: bytes, count: int, marks: list[int], freq: np.ndarray, start: np.ndarray, lookup: np.ndarray,
                 first: int = 0, last: int | None = None) -> np.ndarray:
    """Ranks from checkpoint ``first`` up to checkpoint ``last``, or to the end."""
    state = np.frombuffer(data, np.uint64, LANES, first * LANES * 8).copy()
    stream = np.frombuffer(data, np.uint32, offset=len(marks) * LANES * 8)
    at, steps = marks[first], -(-count // LANES)
    stop = steps if last is None else min(steps, last * CHECKPOINT)
    out = np.empty(min(count, stop * LANES) - first * CHECKPOINT * LANES, np.int64)
    for k, step in enumerate(range(first * CHECKPOINT, stop)):
        n = min(LANES, count - step * LANES)
        x = state[:n]
        slot = x & _MASK
        rank = lookup[slot]
        x = freq[rank] * (x >> _SHIFT) + slot - start[rank]
        low = np.flatnonzero(x < _FLOOR)
        x[low] = (x[low] << _WORD) | stream[at:at + len(low)]
        at += len(low)
        state[:n] = x
        out[k * LANES:k * LANES + n] = rank
    return out


def encode_segment(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of whole documents; ``ids`` holds ``counts[i]`` of document i, one after another."""
    symbols, freq = frequency_table(ids) if len(ids) else (np.zeros(0, np.uint32), np.zeros(0, np.uint32))
    wide, start = freq.astype(np.uint64), (np.cumsum(freq, dtype=np.uint64) - freq).astype(np.uint64)
    ranks = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 0, np.int64)
    ranks[symbols] = np.arange(len(symbols))
    blocks, notes = [], []
    for at in range(0, len(ids), BLOCK):
        part = ids[at:at + BLOCK]
        data, marks = encode_block(ranks[part], wide, start)
        step = CHECKPOINT * LANES
        notes.append({"ids": len(part), "bytes": len(data), "crc": zlib.crc32(data), "marks": marks,
                      "id_crcs": [zlib.crc32(part[k:k + step].astype("<u4").tobytes()) for k in range(0, len(part), step)]})
        blocks.append(data)
    documents = zlib.compress(doc_ids.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + counts.astype("<u4").tobytes(), 1)
    table = zlib.compress(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    header = json.dumps({"docs": len(doc_ids), "documents": [len(documents), zlib.crc32(documents)], "symbols": len(symbols),
                         "table": [len(table), zlib.crc32(table)], "blocks": notes}).encode()
    return b"".join([MAGIC, np.array([len(header), zlib.crc32(header)], "<u4").tobytes(), header, documents, table, *blocks])


def _checked(data: bytes, at: int, size: int, crc: int, what: str) -> bytes:
    part = data[at:at + size]
    if len(part) != size or zlib.crc32(part) != crc:
        raise Corrupt(f"{what} at byte {at} fails its check")
    return part


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``doc_ids, nulls, counts, ids`` of a segment; raises ``Corrupt`` where a checksum fails."""
    if data[:4] != MAGIC or len(data) < 12:
        raise Corrupt("no segment begins here")
    size, crc = np.frombuffer(data, "<u4", 2, 4).tolist()
    header = json.loads(_checked(data, 12, size, crc, "the header"))
    at, n, s = 12 + size, header["docs"], header["symbols"]
    raw = zlib.decompress(_checked(data, at, *header["documents"], "the list of documents"))
    doc_ids, nulls = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n)
    counts = np.frombuffer(raw, "<u4", n, 9 * n).astype(np.int64)
    at += header["documents"][0]
    raw = zlib.decompress(_checked(data, at, *header["table"], "the table"))
    symbols, freq = np.frombuffer(raw, "<u4", s), np.frombuffer(raw, "<u4", s, 4 * s).astype(np.uint64)
    at += header["table"][0]
    start, lookup = (np.cumsum(freq) - freq).astype(np.uint64), np.repeat(np.arange(s), freq.astype(np.int64))
    out = [np.zeros(0, np.uint32)]
    for k, note in enumerate(header["blocks"]):
        part = symbols[decode_block(_checked(data, at, note["bytes"], note["crc"], f"block {k}"), note["ids"], note["marks"], freq, start, lookup)]
        step = CHECKPOINT * LANES
        if [zlib.crc32(part[j:j + step].tobytes()) for j in range(0, len(part), step)] != note["id_crcs"]:
            raise Corrupt(f"block {k} decodes to other ids")
        out.append(part)
        at += note["bytes"]
    return doc_ids, nulls, counts, np.concatenate(out)


MANIFEST = "shard int, segment int, path string, start long, bytes long, docs long, ids long"


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 1) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` in ascending doc_id order to files in ``folder``; returns the committed manifest.

    One file a shard of the doc_id order. A null doc_id comes first; rows of one doc_id follow each other by text. A
    null text is empty and so holds only the ``end`` id. Memory in a task is one segment or one text, whichever is more.
    """
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard, encoder = TaskContext.get().partitionId(), word_tokenizer(tokenizer, REMEMBERED_BYTES)
        rows, held, size, place = [], [], 0, 0
        path = stream = None

        def flush() -> None:
            nonlocal path, stream, held, size, place
            if not held:
                return
            if stream is None:
                path, stream = store.create(folder, ".rans")
            doc_ids, nulls, counts, ids = map(np.concatenate, zip(*held))
            data = encode_segment(doc_ids, nulls, counts, ids)
            stream.write(data)
            rows.append((shard, len(rows), path, place, len(data), len(doc_ids), len(ids)))
            place, held, size = place + len(data), [], 0

        try:
            for part in slices(batches, "text", SLICE_BYTES // 2):
                ids, counts = encoder.encode(part["text"], end)
                if size and size + len(ids) > SEGMENT:
                    flush()
                doc_ids = part["doc_id"]
                held.append((doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False), counts, ids))
                size += len(ids)
            flush()
        finally:
            if stream is not None:
                stream.close()
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4))],
                                             ["shard", "segment", "path", "start", "bytes", "docs", "ids"])

    ordered = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
               .repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text"))
    return cut_lineage(ordered.mapInArrow(write, MANIFEST))


def read_ids(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` (binary, little-endian u32) of every document in the files of a manifest, segment by segment.

    ``start`` counts the ids of all documents before. Segments are decoded in parallel; their starts are running sums over
    the manifest, a row for each segment.
    """
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, nulls, counts, ids = decode_segment(store.read(row["path"], row["start"], row["bytes"]))
                if len(doc_ids) != row["docs"] or len(ids) != row["ids"]:
                    raise Corrupt(f"{row['path']} differs from its manifest")
                ends = np.cumsum(counts)
                starts = ends - counts
                for a in range(0, len(doc_ids), 1024):
                    b = min(a + 1024, len(doc_ids))
                    edge = (np.append(starts[a:b], ends[b - 1]) - starts[a]) * 4
                    blob = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(edge.astype(np.int64)),
                                                 pa.py_buffer(ids[starts[a]:ends[b - 1]].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], mask=nulls[a:b].astype(bool)),
                                                      pa.array(starts[a:b] + row["before"]), blob.cast(pa.binary())], ["doc_id", "start", "ids"])

    shards = manifest.groupBy("shard").agg(F.sum("ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("b"))
    inner = Window.partitionBy("shard").orderBy("segment")
    placed = (manifest.withColumn("inner", F.sum("ids").over(inner) - F.col("ids")).join(before, "shard")
              .withColumn("before", F.col("b") + F.col("inner")).drop("b", "inner"))
    # Asked for by number: the rows are few and small, and Spark would put them all in one task.
    tasks = max(1, min(MOST_TASKS, manifest.count()))
    return placed.repartition(tasks, "path", "segment").mapInArrow(read, "doc_id long, start long, ids binary")


def id_digests(docs: DataFrame, tokenizer: str, end: int | None = 1) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, from files written and read back."""
    manifest = write_ids(docs, store.new_folder(docs.sparkSession, "ids"), tokenizer, end)
    return read_ids(manifest).select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
                                     F.crc32("ids").alias("ids_crc32"))
