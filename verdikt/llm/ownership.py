"""Secrets in texts, told apart by who holds them: corpus-wide ownership frequency.

A scan finds spans of three base kinds and, as a fourth, long tokens of mixed letters and digits that look generated. What
each span holds is known by its SHA-256 from then on. Over the whole corpus the distinct owners and the distinct
repositories of each hash are counted: a value with many owners was copied from an example, one with few owners that looks
generated is a credential of theirs. Counts are summed by (hash, owner, repository) first, so that a value which a third
of all documents hold costs each task one row for each of its repositories, and occurrences of such a value meet their
verdict by broadcast.

Edge cases: a null or empty text has no spans; null owners are one owner, null repositories one repository of their owner;
each row of the input gives one row, repeated rows and null ids included; columns other than those named are ignored; an
empty table gives an empty result. A text is scanned whole, at any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from verdikt.llm.batches import slices
from verdikt.llm.skew import join_by_counts
from verdikt.operators.lineage import cut_lineage

#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "owned")
#: A value is widely copied from so many distinct owners on, or from so many distinct repositories.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 100
#: Marks of values that are made up for documentation.
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "xxxx", "0000", "1234")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS, _HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
_TOKEN = re.compile("[A-Za-z0-9+/_=-]+")
#: A text without a match of this has no span.
_ANY = "(?i)password|passwd|secret|token|api_?key|(?-i:AKIA[A-Z0-9]{12})|[0-9a-f]{32}|[A-Za-z0-9+/_=-]{20}"

_FOUND = "array<struct<kind int, start int, end int, hash string, live boolean>>"


def looks_live(value: str) -> bool:
    """Two digits, two letters, eight distinct characters and no placeholder in it."""
    low = value.lower()
    return (len(set(value)) >= 8 and sum(c.isdigit() for c in value) >= 2 and sum(c.isalpha() for c in value) >= 2
            and not any(p in low for p in PLACEHOLDERS))


def _generated(value: str) -> bool:
    """What a bare token must have: three capitals, three small letters, three digits, twelve distinct characters."""
    return (sum("A" <= c <= "Z" for c in value) >= 3 and sum("a" <= c <= "z" for c in value) >= 3
            and sum(c.isdigit() for c in value) >= 3 and len(set(value)) >= 12 and looks_live(value))


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """``kind, start, end, value`` of the base spans, by start and kind, and of the bare tokens that touch none of them."""
    found = [(0, *m.span(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(1, *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(2, *m.span(), m[0]) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    found.sort(key=lambda s: (s[1], s[0]))
    bare, k, reach = [], 0, 0
    for m in _TOKEN.finditer(text):
        if m.end() - m.start() < 20 or not _generated(m[0]):
            continue
        while k < len(found) and found[k][1] < m.end():
            reach = max(reach, found[k][2])
            k += 1
        if reach <= m.start():
            bare.append((3, *m.span(), m[0]))
    return found + bare


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("live", pa.bool_())]))
    for part in slices(batches, "text"):
        some = pc.fill_null(pc.match_substring_regex(part["text"], _ANY), False).to_pylist()
        rows = [candidates(text.as_py()) if hit else [] for hit, text in zip(some, part["text"])]
        digests = [hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in row if k < 3).encode()).hexdigest() for row in rows]
        found = [[{"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v.encode()).hexdigest(), "live": looks_live(v)}
                  for k, a, b, v in row] for row in rows]
        yield pa.RecordBatch.from_arrays([part["doc_id"], part["owner"], part["repository"], pa.array(digests), pa.array(found, kind)],
                                         ["doc_id", "owner", "repository", "base_sha256", "found"])


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: its number ``row``, owner, repository, base digest and what was found."""
    return cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).mapInArrow(_scan, f"doc_id long, owner string, repository string, base_sha256 string, found {_FOUND}")
        .withColumn("row", F.monotonically_increasing_id()))


def ownership(scanned: DataFrame) -> DataFrame:
    """``hash, n, n_owners, n_repositories, copied`` of every value; ``n`` counts its spans."""
    held = (scanned.where(F.size("found") > 0).select("owner", "repository", F.explode("found.hash").alias("hash"))
            .groupBy("hash", "owner", "repository").agg(F.count("*").alias("n")))
    of_owner = held.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    return of_owner.groupBy("hash").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories")
    ).withColumn("copied", (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repositories") >= COPIED_REPOSITORIES))


def judged(scanned: DataFrame, values: DataFrame) -> DataFrame:
    """A row for each span of ``scan`` with the figures of its value and ``verdict``: copied, live or plain."""
    spans = scanned.where(F.size("found") > 0).select("row", "doc_id", F.explode("found").alias("s")).select("row", "doc_id", "s.*")
    figures = values.select("hash", F.col("n").alias("spans_of_value"), "n_owners", "n_repositories", "copied", F.col("n").alias("_n"))
    return join_by_counts(spans, figures, "hash", "_n").withColumn(
        "verdict", F.when(F.col("copied"), "copied").when(F.col("live"), "live").otherwise("plain"))


def secrets(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Every span: ``doc_id, kind, start, end, hash, n_owners, n_repositories, verdict``; the value itself is not repeated.

    Bare tokens are listed only where they are live: of kind ``owned``.
    """
    scanned = scan(docs, owner, repository)
    return (judged(scanned, cut_lineage(ownership(scanned))).where((F.col("kind") < 3) | (F.col("verdict") == "live"))
            .select("doc_id", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("kind"), "start", "end", "hash",
                    "n_owners", "n_repositories", "verdict"))


def by_document(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied`` of every row of ``docs``.

    ``spans`` lists the base spans and those of kind ``owned`` as kind:start:end by start, then kind.
    """
    scanned = scan(docs, owner, repository)
    spans = judged(scanned, cut_lineage(ownership(scanned))).where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    listed = spans.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("shown")))).alias("all"),
        *[F.count(F.when(F.col("verdict") == v, 1)).alias(f"n_{v}") for v in ("live", "copied")])
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = ["doc_id", *map(count, range(3)), "base_sha256"]
    zero = F.lit(0).cast("long")
    some = scanned.where(F.size("found") > 0).join(listed, "row", "left").select(
        *base, F.array_join(F.coalesce(F.col("all.shown"), F.array().cast("array<string>")), ",").alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))
    return some.union(scanned.where(F.size("found") == 0).select(*base, F.lit("").alias("spans"), zero, zero))
