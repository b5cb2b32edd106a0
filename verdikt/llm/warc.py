"""WARC archives of pages: a writer that stores equal payloads once, and a reader that salvages damaged files.

A page is one record in a gzip member of its own. Of pages with equal payloads the one with the smallest page_id is a
``response``; the others are ``revisit`` records without payload that name it. Both carry digest and length of the full
payload.

The reader checks each record (member crc, version line, length, block digest, payload digest, closing lines). Where a
check fails it searches on from the next byte for a gzip member or version line whose record passes, goes on from there,
and reports the bytes between as a gap; no byte of a file is in neither.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from verdikt.llm import store
from verdikt.llm.batches import slices
from verdikt.llm.skew import join_by_counts
from verdikt.operators.lineage import cut_lineage

ROLL_BYTES = 64 << 20
MOST_TASKS = 20_000
WRITTEN_AT = "1970-01-01T00:00:00Z"

# Fixed values of the WARC format.
VERSION = b"WARC/1.1\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"[^\r:]*+:")
_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One record, not compressed. Bytes of a url that a header line cannot hold are percent-encoded."""
    digest = base32_sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _id(page_id), "WARC-Date": WRITTEN_AT}
    if url is not None:
        lines["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if revisit:
        lines |= {"WARC-Profile": REVISIT, "WARC-Refers-To": _id(first)}
    else:
        block += payload
    lines |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Payload-Length": str(len(payload)),
              "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": "application/http; msgtype=response",
              "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode("utf-8", "surrogatepass")
    return VERSION + head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class Found(NamedTuple):
    """A record at ``start``, or with ``headers`` None a gap, of ``length`` bytes of the file."""
    start: int
    length: int
    headers: dict[str, str] | None
    payload: bytes | None
    why: str | None


def _parse(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """``end, headers, payload`` of the record at ``at``; ValueError where it fails a check."""
    version = _VERSION.match(data, at)
    if not version:
        raise ValueError("no version line")
    if not _FIELD.match(data, version.end()) and not data.startswith(b"\r\n", version.end()):
        raise ValueError("a header line has no colon")
    close = data.find(b"\r\n\r\n", version.end() - 2)
    if close < 0:
        raise ValueError("headers do not end")
    headers = {}
    for line in data[version.end():close].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line has no colon")
        headers[name.decode("latin-1").strip().lower()] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdecimal():
        raise ValueError("no length")
    start = close + 4
    end = start + int(headers["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError("the block does not end where its length says")
    block = data[start:end]
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != base32_sha1(block):
        raise ValueError("block digest differs")
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    told = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and told.startswith("sha1:") and told[5:] != base32_sha1(payload):
        raise ValueError("payload digest differs")
    return end + 4, headers, payload


def _records_at(data: bytes, at: int) -> tuple[int, list[tuple[dict[str, str], bytes]]]:
    """End of the member or plain record at ``at`` and the records in it; ValueError where a check fails."""
    if data[at:at + 3] != b"\x1f\x8b\x08":
        end, headers, payload = _parse(data, at)
        return end, [(headers, payload)]
    inflate = zlib.decompressobj(31)
    try:
        plain = inflate.decompress(memoryview(data)[at:])
    except zlib.error as bad:
        raise ValueError(f"gzip: {bad}") from None
    if not inflate.eof:
        raise ValueError("gzip: the member does not end")
    found, place = [], 0
    while place < len(plain):
        place, headers, payload = _parse(plain, place)
        found.append((headers, payload))
    return len(data) - len(inflate.unused_data), found


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of a file, which together cover it from first to last byte."""
    at = gap = 0
    why = ""
    while at < len(data):
        try:
            end, found = _records_at(data, at)
        except ValueError as bad:
            why = why or str(bad)
            ahead = _BEGIN.search(data, at + 1)
            at = ahead.start() if ahead else len(data)
            continue
        if gap < at:
            yield Found(gap, at - gap, None, None, why)
        for headers, payload in found:
            yield Found(at, end - at, headers, payload, None)
        at = gap = end
        why = ""
    if gap < len(data):
        yield Found(gap, len(data) - gap, None, None, why)


MANIFEST = "path string, bytes long, records long"
CONTENT = "path string, start long, length long, headers map<string,string>, payload binary, gap string"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` to archives in ``folder``; returns the committed manifest.

    A null html is an empty payload and a null page_id sorts after all others. Repeated rows of the smallest page_id are
    each a response: they tie for it. A file is closed once it has ``ROLL_BYTES``.
    """
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, path, stream, size, count = [], None, None, 0, 0
        try:
            for part in slices(batches, "html"):
                for page_id, url, html, first in zip(*(part[c].to_pylist() for c in ("page_id", "url", "html", "first"))):
                    if stream is None:
                        path, stream = store.create(folder, ".warc.gz")
                    data = member(record(page_id, url, html.encode("utf-8", "surrogatepass"), first, page_id != first))
                    stream.write(data)
                    size, count = size + len(data), count + 1
                    if size >= ROLL_BYTES:
                        stream.close()
                        rows.append((path, size, count))
                        stream, size, count = None, 0, 0
        finally:
            if stream is not None:
                stream.close()
                rows.append((path, size, count))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         ["path", "bytes", "records"])

    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = pages.withColumn("digest", F.concat_ws(":", F.sha1("html"), F.octet_length("html")))
    groups = cut_lineage(keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")))
    return cut_lineage(join_by_counts(keyed, groups, "digest", "n").select("page_id", "url", "html", "first").mapInArrow(write, MANIFEST))


def read_archives(manifest: DataFrame) -> DataFrame:
    """Everything in the files ``path``, of ``bytes`` bytes, as ``CONTENT``: records, and gaps with what failed first there."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(path: str, found: list[Found]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([path] * len(found)), pa.array([f.start for f in found], pa.int64()), pa.array([f.length for f in found], pa.int64()),
                pa.array([None if f.headers is None else list(f.headers.items()) for f in found], pa.map_(pa.string(), pa.string())),
                pa.array([f.payload for f in found], pa.binary()), pa.array([f.why for f in found], pa.string()),
            ], ["path", "start", "length", "headers", "payload", "gap"])

        for batch in batches:
            for path, size in zip(batch["path"].to_pylist(), batch["bytes"].to_pylist()):
                held, weight = [], 0
                for found in salvage(store.read(path, 0, size)):
                    held.append(found)
                    weight += len(found.payload or b"") + 500
                    if weight > 4 << 20:
                        yield out(path, held)
                        held, weight = [], 0
                if held:
                    yield out(path, held)

    # Asked for by number: the rows are few and small, and Spark would put them all in one task.
    tasks = max(1, min(MOST_TASKS, manifest.count()))
    return manifest.select("path", "bytes").repartition(tasks, "path").mapInArrow(read, CONTENT)


def page_records(content: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the page records read back."""
    number = lambda name: F.nullif(F.regexp_extract(F.col("headers")[name], _PAGE.pattern, 1), F.lit("")).cast("long")
    return content.where("headers is not null").select(
        number("warc-record-id").alias("page_id"), F.col("headers")["warc-payload-length"].cast("long").alias("payload_bytes"),
        F.regexp_replace(F.col("headers")["warc-payload-digest"], "^sha1:", "").alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"), number("warc-refers-to").alias("refers_to"))


def gaps(content: DataFrame) -> DataFrame:
    """The log of quarantined bytes: ``path, start, length, gap``."""
    return content.where("headers is null").select("path", "start", "length", "gap")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads the archives back, a row a page. An empty table gives no file and no row."""
    return page_records(read_archives(write_archives(pages, store.new_folder(pages.sparkSession, "warc"))))
