"""Archives come back whole; damaged ones give the records that are whole and name the bytes that are not."""

import base64
import hashlib
import random

from verdikt.llm import store, warc


def plain(rows):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if page is not None:
            first[body] = min(page, first.get(body, page))
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        lowest = first.get(body)
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "response" if page == lowest else "revisit", None if page == lowest else lowest))
    return sorted(out, key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_round_trip_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROLL_BYTES", 3000)
    rng = random.Random(4)
    bodies = ["", None, "<p>é\r\n\r\nWARC/1.1\r\n", "x" * 50_000, "<b>a", "\x00\x1f\x08"]
    rows = [(k, f"http://a/{k}", rng.choice(bodies) if k % 2 else f"<p>{k}") for k in range(120)]
    rows += [(-5, None, "<b>a"), (7, "u\r\nWARC-Type: x", "<p>8"), (500, "u", "only"), (500, "u", "only"), (None, "u", "<b>a"), (None, "v", "lone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as first", "'d' as digest", "2 as n").repartition(3)
    assert as_rows(warc.archived_pages(df)) == plain(rows)


def test_hot_payload(spark, monkeypatch):
    from verdikt.llm import skew
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rows = [(k, "u", "same" if k % 3 else f"{k}") for k in range(60)]
    assert as_rows(warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))) == plain(rows)


def test_empty_table(spark):
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def _covers(found, size):
    at = 0
    for f in found:
        assert f.start in (at, last_start) if at else f.start == 0
        last_start, at = f.start, f.start + f.length
    assert at == size


def test_salvage_of_damaged_files():
    payloads = [f"<p>{'abc' * k} {k}".encode() for k in range(40)]
    for pack in (warc.member, bytes):
        parts = [pack(warc.record(k, f"http://x/{k}", p, None, False)) for k, p in enumerate(payloads)]
        whole = b"".join(parts)
        assert [f.payload for f in warc.salvage(whole)] == payloads
        hurt = list(parts)
        hurt[3] = hurt[3][:-30] + bytes(8) + hurt[3][-22:]     # bytes overwritten
        hurt[9] = hurt[9][:-25]                              # cut short
        hurt[20] = b""                                       # lost: no trace
        hurt[30] = b"\x1f\x8b\x08noise WARC/1.1\r\n" + hurt[30]   # noise that looks like a beginning
        data = b"tail of something" + b"".join(hurt) + parts[0][:50]
        found = list(warc.salvage(data))
        _covers(found, len(data))
        assert [f.payload for f in found if f.headers] == [p for k, p in enumerate(payloads) if k not in (3, 9, 20)]
        spans = [(f.start, f.length) for f in found if not f.headers]
        at = 17
        expected = [(0, 17)]
        for k, p in enumerate(hurt):
            if k in (3, 9):
                expected.append((at, len(p)))
            if k == 30:
                expected.append((at, len(p) - len(parts[30])))
            at += len(p)
        assert spans == [*expected, (at, 50)]
        assert all(f.why for f in found if not f.headers)


def test_members_of_several_records_and_gap_log(spark, tmp_path):
    several = warc.member(b"".join(warc.record(k, "u", b"p%d" % k, None, False) for k in range(5)))
    path, stream = store.create(f"file:{tmp_path}", ".warc.gz")
    with stream:
        stream.write(several + b"garbage" + several)
    manifest = spark.createDataFrame([(path, 2 * len(several) + 7, 10)], warc.MANIFEST)
    content = warc.read_archives(manifest)
    assert [r.page_id for r in warc.page_records(content).collect()] == [0, 1, 2, 3, 4] * 2
    (gap,) = warc.gaps(content).collect()
    assert (gap.start, gap.length) == (len(several), 7) and gap.gap


def test_long_urls_come_back(spark):
    rows = [(1, "data:," + "x" * 200_000, "<p>a"), (2, "http://x/?" + " " * 70_000, "<p>b"), (3, "http://x/3", "<p>c")]
    assert as_rows(warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))) == plain(rows)
    for pack in (warc.member, bytes):
        (found,) = warc.salvage(pack(warc.record(1, rows[0][1], b"p", None, False)))
        assert found.headers["warc-target-uri"] == rows[0][1]
