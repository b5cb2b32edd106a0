"""Secrets against a plain scan, and the ownership that decides between copies and credentials."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from verdikt.llm import ownership

SCHEMA = "doc_id long, text string, lang string, source string, hash string, row long, owner string, found int, kind int"
LIVE = "9f8e7d6c5b4a39281706"
TOKEN = "Zx81kQw7Lm20PvBt94Rs"


def rows(texts):
    return [(k, text, "en", source, "x", 1, "y", 2, 3) for k, (text, source) in enumerate(texts)]


def plain_base(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m[2]) >= 8]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(spans, key=lambda s: (s[1], order[s[0]]))


TEXTS = [
    (None, "a"), ("", None), ("no secret here", "a"), ("password = short", "a"), ('é TOKEN: "' + LIVE + '" tail', "a"),
    ("paſſword=abcdefgh1234 toKen=abcdefgh9", "b"), ("AKIA" + "Q7" * 8 + " AKIA12", "b"), ("0123456789abcdef" * 2 + "X", "c"),
    ("api_key=" + "f0" * 20 + " apikey='" + LIVE + "'", "a"), ("token=x=" + LIVE, None), ("\U0001f600 secret:" + LIVE, "z"),
    ("plain " + TOKEN + " there", "q"), ("password=" + TOKEN, "q"), ("x" * 200_000 + " token=" + LIVE + " y" * 100_000, "a"),
    ("passwordpassword=abcdefgh", "a"), ("secret==abc", "d"), ("secret= =abcdefgh", "d"),
]


def test_base_spans_are_those_of_a_plain_scan(spark):
    docs = spark.createDataFrame(rows(TEXTS) + rows(TEXTS)[:6], SCHEMA)
    got = ownership.by_document(docs, F.col("source"), F.col("doc_id")).collect()
    assert len(got) == len(TEXTS) + 6
    for row in got:
        base = plain_base(TEXTS[row.doc_id][0])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), TEXTS[row.doc_id]
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        assert [s for s in row.spans.split(",") if s and not s.startswith("owned")] == [f"{k}:{a}:{b}" for k, a, b in base]


def test_values_of_many_owners_are_copies_and_of_few_are_live(spark):
    texts = [(f"token={LIVE}", f"owner{k % 3}") for k in range(30)] + [(f"token={LIVE[::-1]}", f"owner{k % 2}") for k in range(30)]
    texts += [("token=changeme1234abcd", "owner9"), (f"see {TOKEN}", "owner9"), (f"see {TOKEN[::-1]}", "a"), (f"see {TOKEN[::-1]}", "b"), (f"see {TOKEN[::-1]}", "c")]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: r for r in ownership.by_document(docs, F.col("source"), F.col("doc_id")).collect()}
    assert all(got[k].n_copied == 1 and got[k].n_live == 0 for k in range(30))
    assert all(got[k].n_copied == 0 and got[k].n_live == 1 for k in range(30, 60))
    assert (got[60].n_live, got[60].n_copied, got[60].spans) == (0, 0, "assign:0:22")
    assert (got[61].spans, got[61].n_live) == ("owned:4:24", 1) and got[62].spans == ""
    found = ownership.secrets(docs, F.col("source"), F.col("doc_id")).collect()
    by_hash = defaultdict(set)
    for r in found:
        by_hash[r.hash].add((r.n_owners, r.n_repositories, r.verdict))
    assert by_hash[hashlib.sha256(LIVE.encode()).hexdigest()] == {(3, 30, "copied")}
    assert by_hash[hashlib.sha256(LIVE[::-1].encode()).hexdigest()] == {(2, 30, "live")}


def test_many_repositories_of_one_owner_are_copies_too(spark):
    docs = spark.createDataFrame(rows([(f"secret={LIVE}", None)] * ownership.COPIED_REPOSITORIES), SCHEMA)
    assert {r.verdict for r in ownership.secrets(docs, F.col("source"), F.col("doc_id")).collect()} == {"copied"}
    assert {r.verdict for r in ownership.secrets(docs, F.col("source"), F.lit(None)).collect()} == {"live"}


def test_an_empty_table_has_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert ownership.by_document(docs, F.col("source"), F.col("doc_id")).collect() == []
    assert ownership.secrets(docs, F.col("source"), F.col("doc_id")).collect() == []


@pytest.mark.parametrize("text", ["password=" + "a" * 8, "AKIA" + "A" * 12, "a" * 32])
def test_least_lengths(text):
    assert len(ownership.candidates(text)) == 1 and not ownership.candidates(text[:-1])
