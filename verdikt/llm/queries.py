"""The corpus queries, as ``(spark, folder) -> DataFrame``, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from verdikt.llm import ann, collocations, crossent, decontaminate, langid, layout, ownership, pieces, prefixes, quality, rans, simhash, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_rans_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return rans.id_digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_latent_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"))
    held_out = F.coalesce(quality.remainder(5) == 0, F.lit(False))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op4_sentencepiece_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text", "ids")


@query
def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op6_layout_text(spark: SparkSession, folder: str) -> DataFrame:
    return layout.extract(table(spark, folder, "pages").select("page_id", "html"))


@query
def op7_cross_entropy_difference(spark: SparkSession, folder: str) -> DataFrame:
    good = table(spark, folder, "labels").where("quality = 1")
    return crossent.score(crossent.with_target(table(spark, folder, "documents"), good), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_balanced_posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    return ann.neighbours(table(spark, folder, "embeddings"))


ORACLES["op9_warc_salvage"] = """
WITH digests AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
  firsts AS (SELECT hex, n, min(page_id) AS first FROM digests GROUP BY hex, n)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(list_transform(range(0, 8), lambda g: CAST('0x' || substr(d.hex, CAST(5 * g + 1 AS INTEGER), 5) AS INTEGER)), lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32768) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 1024) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN d.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN d.page_id <> f.first THEN f.first END AS refers_to
FROM digests AS d JOIN firsts AS f ON f.hex = d.hex AND f.n = d.n"""


@query
def op9_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived_pages(table(spark, folder, "pages"))


@query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(quality.remainder(3) == 1, F.lit(False))
    return langid.predict(docs.select("doc_id", "text"), langid.fit(docs)).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


#: A source is an owner, a document one of its repositories.
ORACLES["op11_secret_ownership"] = r"""
WITH docs AS (SELECT row_number() OVER () AS row, CAST(doc_id AS BIGINT) AS doc_id, source AS owner, CAST(doc_id AS VARCHAR) AS repository, coalesce(text, '') AS text FROM documents),
  kinds(kind, name, pattern, least) AS (VALUES
    (0, 'assign', '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 0),
    (1, 'access', 'AKIA[A-Z0-9]+', 16), (2, 'hex', '[0-9a-f]+', 32), (3, 'owned', '[A-Za-z0-9+/_=-]+', 20)),
  cut AS (SELECT d.*, k.kind, k.name, k.least, regexp_extract_all(d.text, k.pattern) AS hits, string_split_regex(d.text, k.pattern) AS gaps
    FROM docs AS d CROSS JOIN kinds AS k WHERE d.text <> ''),
  placed AS (SELECT row, owner, repository, kind, name, least, i, hits[i] AS hit,
      list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0) AS start
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM cut WHERE len(hits) > 0)),
  valued AS (SELECT row, owner, repository, kind, name, least, CAST(start AS BIGINT) AS start, CAST(start + length(hit) AS BIGINT) AS stop, hit,
      CASE WHEN kind = 0 THEN regexp_extract(hit, '(?i)^(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE hit END AS value FROM placed
    WHERE length(hit) >= least),
  kept AS (SELECT *, length(regexp_replace(value, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(value, '[^A-Z]', '', 'g')) AS capitals,
      length(regexp_replace(value, '[^a-z]', '', 'g')) AS smalls, len(list_distinct(string_split(value, ''))) AS different FROM valued WHERE kind > 0 OR length(value) >= 8),
  looked AS (SELECT *, different >= 8 AND digits >= 2 AND capitals + smalls >= 2 AND NOT regexp_matches(lower(value), 'example|sample|dummy|changeme|xxxx|0000|1234') AS live FROM kept),
  found AS (SELECT * FROM looked AS t WHERE kind < 3 OR (live AND capitals >= 3 AND smalls >= 3 AND digits >= 3 AND different >= 12
    AND NOT EXISTS (SELECT 1 FROM looked AS b WHERE b.row = t.row AND b.kind < 3 AND b.start < t.stop AND b.stop > t.start))),
  figures AS (SELECT value, count(DISTINCT coalesce(owner, chr(0))) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM found GROUP BY value),
  judged AS (SELECT f.*, CASE WHEN v.owners >= 3 OR v.repositories >= 100 THEN 'copied' WHEN f.live THEN 'live' ELSE 'plain' END AS verdict
    FROM found AS f JOIN figures AS v ON v.value = f.value),
  shown AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
      string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base,
      string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans,
      count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'copied') AS n_copied
    FROM judged WHERE kind < 3 OR verdict = 'live' GROUP BY row)
SELECT d.doc_id, coalesce(s.n_assign, 0) AS n_assign, coalesce(s.n_access, 0) AS n_access, coalesce(s.n_hex, 0) AS n_hex, sha256(coalesce(s.base, '')) AS base_sha256,
  coalesce(s.spans, '') AS spans, coalesce(s.n_live, 0) AS n_live, coalesce(s.n_copied, 0) AS n_copied FROM docs AS d LEFT JOIN shown AS s ON s.row = d.row"""


@query
def op11_secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    return ownership.by_document(table(spark, folder, "documents"), F.col("source"), F.col("doc_id"))


ORACLES["op12_prefix_trie"] = r"""
WITH turns AS (SELECT CAST(conv_id AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  convs AS (SELECT c, count(*) AS n, c - c % 20 AS base,
    (4294967295 - list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: [CAST(ascii(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda acc, e: xor(xor(acc, e) >> 1, (xor(acc, e) & 1) * 3988292384))) % 4 AS h FROM turns GROUP BY c),
  built AS (SELECT v.c, t.place AS d, t.role, t.text FROM convs AS v JOIN turns AS t ON t.c = v.base AND t.place <= v.h
    UNION ALL SELECT v.c, t.place - v.h + least(v.h, coalesce(b.n, 0)), t.role, t.text FROM convs AS v JOIN turns AS t ON t.c = v.c AND t.place > v.h LEFT JOIN convs AS b ON b.c = v.base),
  lists AS (SELECT v.c, coalesce(l.path, []) AS path FROM convs AS v LEFT JOIN (SELECT c, list(sha256(role || chr(0) || text) ORDER BY d) AS path FROM built GROUP BY c) AS l ON l.c = v.c),
  members AS (SELECT c, path, path[1:d] AS node, d FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM lists)),
  nodes AS (SELECT m.node, m.d, min(m.c) AS conv_id, count(*) AS n_convs, min(CASE WHEN m.d = 0 THEN 0 ELSE len(regexp_extract_all(b.text, '[^\x20\x09-\x0D]+')) END) AS words,
      coalesce(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) FILTER (WHERE m.d = len(m.path)), '') AS ends
    FROM members AS m LEFT JOIN built AS b ON b.c = m.c AND b.d = m.d GROUP BY m.node, m.d),
  whole AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes AS n LEFT JOIN nodes AS p ON n.d > 0 AND p.node = n.node[1:n.d - 1]),
  children AS (SELECT node[1:d - 1] AS node, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
  counted AS (SELECT w.*, coalesce(k.k, 0) AS n_children FROM whole AS w LEFT JOIN children AS k ON k.node = w.node),
  sums AS (SELECT top.node, count(*) FILTER (WHERE low.n_children = 0) AS n_leaves, sum((low.n_convs - 1) * low.words) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM counted) AS low
    JOIN counted AS top ON top.node = low.node[1:low.up] GROUP BY top.node)
SELECT c.conv_id, c.d AS depth, c.parent_conv_id, c.n_convs, c.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted AS c JOIN sums AS s ON s.node = c.node"""


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.trie(table(spark, folder, "conversations"))


ORACLES["op13_phrase_collocations"] = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
  starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
  totals AS (SELECT lang, CAST(count(*) AS HUGEINT) AS n FROM starts GROUP BY lang),
  grams AS (SELECT lang, w[i:i + k - 1] AS p, k FROM (SELECT *, unnest(range(1, 6)) AS k FROM starts) WHERE i + k - 1 <= len(w)),
  f AS (SELECT lang, p, k, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, p, k HAVING count(*) >= 100),
  cuts AS (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1),
  scored AS (SELECT t.lang, t.p, t.k, t.f AS a, t.c, l.f AS l, r.f AS r, n.n, (1000 * t.f * n.n) // (l.f * r.f) AS score FROM cuts AS t
    JOIN f AS l ON l.lang = t.lang AND l.p = t.p[1:t.c] JOIN f AS r ON r.lang = t.lang AND r.p = t.p[t.c + 1:t.k] JOIN totals AS n ON n.lang = t.lang),
  weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
  inner_parts AS (SELECT lang, p[i:i + m - 1] AS p, f FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2))),
  covers AS (SELECT lang, p, max(f) AS longer FROM inner_parts GROUP BY lang, p),
  kept AS (SELECT w.* FROM weakest AS w LEFT JOIN covers AS c ON c.lang = w.lang AND c.p = w.p WHERE c.longer IS NULL OR 100 * c.longer < 100 * w.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) <= 2000"""


@query
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
