"""Queries over the steps between a payload and the standings: credited schools, linked people, made-up entries, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verdikt.functions import labels as L
from verdikt.operators import boards as Q, brackets as B, cases as E, identity as I, matching as M, reconcile as K
from verdikt.plans.driver_tables import DriverTables
from verdikt.plans.registry import CTES, query
from verdikt.plans.scoring_queries import entry_results, team_standings
from verdikt.sources import sheet as SH


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _nation(shift: int = 0) -> Column:
    return (F.regexp_replace("school_id", "n", "").cast("int") + shift) % 25


def _index(t: DriverTables) -> DataFrame:
    n = t.raw("nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"),
                               F.concat(F.lit("Nat "), _s("n_nationkey")).alias("short_name"), F.lit("r").alias("region"))
    return M.school_index(n, n.where("pos % 2 = 0").select("name"), None)


CTES["numbered"] = "SELECT e.*, CAST(replace(school_id, 'n', '') AS INTEGER) AS n FROM entries AS e"


@query("credited_schools", """
SELECT entry_id, CASE WHEN supp % 3 = 0 THEN 'sch_nation' || CAST((n + 1) % 25 AS VARCHAR) WHEN supp % 4 = 3 THEN 'sch_new' || CAST(supp AS VARCHAR) ELSE 'sch_nation' || CAST(n AS VARCHAR) END AS school_id,
  CASE WHEN supp % 3 = 0 THEN 'NATION_' || CAST((n + 1) % 25 AS VARCHAR) WHEN supp % 4 = 3 THEN 'New ' || CAST(supp AS VARCHAR) ELSE 'NATION_' || CAST(n AS VARCHAR) END AS school_title,
  CASE WHEN supp % 3 = 0 AND supp % 10 = 3 THEN 'sch_nation' || CAST((n + 2) % 25 AS VARCHAR) END AS hybrid_school_id FROM numbered""")
def credited_schools(t):
    """The league credits every third entry to the next nation, some of them half to the one after."""
    s = F.col("supp")
    e = t.entries.select("entry_id", "supp", "school_id")
    named = e.withColumn("school_name", F.when(s % 4 == 3, F.concat(F.lit("New "), _s(s))).otherwise(F.concat(F.lit("NATION_"), _s(_nation()))))
    said = e.where(s % 3 == 0).select("entry_id", F.concat(F.lit("NATION_"), _s(_nation(1))).alias("school"),
                                      F.when(s % 10 == 3, F.concat(F.lit("nat "), _s(_nation(2)))).alias("hybrid_school"))
    return E.credit_school(named, said, _index(t)).select("entry_id", "school_id", "school_title", "hybrid_school_id")


CTES["linked"] = """SELECT e.entry_id, e.school_id, w.debater_id, p.first, p.last FROM entries AS e JOIN who AS w ON w.supp = e.supp JOIN people AS p ON p.debater_id = w.debater_id WHERE e.supp % 6 <> 1
  UNION ALL SELECT entry_id, school_id, 'lbl_nation' || replace(school_id, 'n', '') || lower(x[2]) || CAST(supp AS VARCHAR) || '_' || lower(x[1]), x[1], replace(x[2], '_', '') || CAST(supp AS VARCHAR)
  FROM entries, (VALUES (['Cara', '_Vale']), (['Rory', '_Hu'])) AS v(x) WHERE supp % 6 = 1"""


@query("linked_debaters", "SELECT * FROM linked")
def linked_debaters(t):
    """Every sixth entry has no registered students, only a label."""
    s = F.col("supp")
    e = t.entries.select("tournament_id", "entry_id", "school_id", "supp", F.when(s % 6 == 1, F.array().cast("array<string>")).otherwise(F.col("student_ids")).alias("student_ids"),
                         F.lit("no one").alias("name"), F.concat(F.lit("NATION Cara Vale"), _s(s), F.lit(" & Rory Hu"), _s(s)).alias("code"),
                         F.concat(F.lit("NATION_"), _s(_nation())).alias("school_title"))
    students = e.select("tournament_id", F.explode("student_ids").alias("debater_id")).distinct().join(t.people.select("debater_id", "first", "last"), "debater_id")
    return E.link_debaters(e, students.withColumnRenamed("debater_id", "student_id")).select("entry_id", "school_id", "debater_id", "first", "last")


def _made(t: DriverTables) -> tuple[DataFrame, DataFrame]:
    """Results of which every ninth has no entry behind it, and every eighteenth no tournament id."""
    s = F.col("supp")
    cases = t.entries.select("entry_id", F.when(s % 18 != 0, F.col("tournament_id")).alias("tournament_id"), F.concat(F.lit("Cup "), "tournament_id").alias("tournament"),
                             F.concat(F.lit("NATION_"), _s(_nation())).alias("school"), F.when(s % 10 == 3, F.concat(F.lit("New "), _s(s))).alias("hybrid_school"),
                             F.concat(F.lit("Vale"), _s(s)).alias("partner1"), F.when(s % 4 != 0, F.concat(F.lit("Hu"), _s(s))).alias("partner2"))
    return E.synthetic_entries(cases, t.entries.where(s % 9 != 0), _index(t))


CTES["bare"] = """SELECT *, CASE WHEN supp % 18 = 0 THEN 'manual_Cup_' || tournament_id ELSE tournament_id END AS tid FROM numbered WHERE supp % 9 = 0"""


@query("synthetic_entries", """
SELECT entry_id, tid AS tournament_id, tid || '_manual' AS event_id, 'NATION_' || CAST(n AS VARCHAR) || ' Vale' || CAST(supp AS VARCHAR) || CASE WHEN supp % 4 <> 0 THEN ' & Hu' || CAST(supp AS VARCHAR) ELSE '' END AS code,
  'sch_nation' || CAST(n AS VARCHAR) AS school_id, CASE WHEN supp % 10 = 3 THEN 'sch_new' || CAST(supp AS VARCHAR) END AS hybrid_school_id, CASE WHEN supp % 4 <> 0 THEN 2 ELSE 1 END AS team_size FROM bare""")
def synthetic_entries(t):
    return _made(t)[0]


@query("synthetic_links", """
SELECT entry_id, 'lbl_nation' || CAST(n AS VARCHAR) || '_' || lower(x) || CAST(supp AS VARCHAR) AS debater_id, x || CAST(supp AS VARCHAR) AS last, 'sch_nation' || CAST(n AS VARCHAR) AS school_id
FROM bare, (VALUES ('Vale'), ('Hu')) AS v(x) WHERE x = 'Vale' OR supp % 4 <> 0""")
def synthetic_links(t):
    return _made(t)[1].drop("first")


@query("missing_links", "SELECT entry_id FROM results WHERE excluded_reason IS NULL AND points > 0 AND supp % 7 = 0")
def missing_links(t):
    kept = t.entries.where(F.col("supp") % 7 != 0).select("entry_id")
    return E.missing_debater_link(entry_results(t), t.links.join(kept, "entry_id", "left_semi")).select("entry_id")


@query("our_teams", """
SELECT 'team_' || t.season_id || '_' || t.pair AS team_id, t.points, coalesce(s.short_name, s.name) AS school, a.first AS first1, a.last AS last1, b.first AS first2, b.last AS last2
FROM team_totals AS t JOIN people AS a ON a.debater_id = split_part(t.pair, '|', 1) JOIN people AS b ON b.debater_id = split_part(t.pair, '|', 2)
LEFT JOIN home AS h ON h.season_id = t.season_id AND h.pair = t.pair LEFT JOIN schools AS s ON s.school_id = h.school_id""")
def our_teams(t):
    return E.load_our_teams(team_standings(t), t.people, t.schools).select("team_id", "points", "school", "first1", "last1", "first2", "last2")


CTES["merged"] = "SELECT debater_id, 'd' || CAST(CAST(replace(debater_id, 'd', '') AS INTEGER) + 1 AS VARCHAR) AS canonical_id FROM people WHERE CAST(replace(debater_id, 'd', '') AS INTEGER) % 7 = 0"


def _merged(t: DriverTables) -> DataFrame:
    """Every seventh person is another record of the next."""
    i = F.regexp_replace("debater_id", "d", "").cast("int")
    return t.people.where(i % 7 == 0).select("debater_id", F.concat(F.lit("d"), _s(i + 1)).alias("canonical_id"))


@query("pairs_by_entry", """
SELECT entry_id, array_to_string(p, ',') AS people, CASE WHEN len(p) = 2 THEN p[1] || '|' || p[2] END AS pair FROM (
  SELECT e.entry_id, list_sort(list_distinct(list(coalesce(m.canonical_id, w.debater_id)))) AS p FROM entries AS e JOIN who AS w ON w.supp = e.supp
  LEFT JOIN merged AS m ON m.debater_id = w.debater_id GROUP BY e.entry_id) AS x""")
def pairs_by_entry(t):
    return I.pairs_by_entry(t.links, I.canonical_map(t.people, _merged(t))).withColumn("people", F.array_join("people", ","))


@query("stale_identities", """
SELECT t.season_id, t.pair, m.debater_id, m.canonical_id FROM (SELECT season_id, pair, unnest(string_split(pair, '|')) AS d FROM team_totals) AS t JOIN merged AS m ON m.debater_id = t.d""")
def stale_identities(t):
    return I.stale_identity_check(team_standings(t).select("season_id", "pair"), _merged(t)).select("season_id", "pair", "debater_id", "canonical_id")


CTES["deepest"] = """SELECT event_id, entry_id, CASE WHEN sections = 1 AND NOT maj THEN 'second' WHEN sections = 1 THEN 'first' WHEN sections = 2 THEN 'semi' WHEN sections = 4 THEN 'quarter' ELSE 'octo' END AS elim_level
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id, entry_id ORDER BY sections, section_id) AS rn FROM main_sides WHERE sections IN (1, 2, 4, 8)) AS x WHERE rn = 1"""


def _deepest(t: DriverTables) -> DataFrame:
    return B.elim_depth(B.bracket_sides(B.main_bracket(t.rounds, t.ballots), t.ballots, t.entries))


@query("result_labels", """
SELECT event_id, CASE elim_level WHEN 'second' THEN 'Finalist' WHEN 'first' THEN 'Champion' WHEN 'semi' THEN 'Semifinalist' WHEN 'quarter' THEN 'Quarterfinalist' ELSE 'Octafinalist' END AS label,
  CAST(count(*) AS INTEGER) AS entries FROM deepest GROUP BY ALL""")
def result_labels(t):
    return _deepest(t).groupBy("event_id", L.entry_result_label("elim_level").alias("label")).agg(F.count("*").cast("int").alias("entries"))


@query("breaking_records", """
SELECT event_id, wins AS breaking_wins, losses AS breaking_losses FROM (
  SELECT r.event_id, r.wins, r.losses, row_number() OVER (PARTITION BY r.event_id ORDER BY r.wins, r.losses DESC) AS rn FROM record AS r JOIN deepest AS d ON d.entry_id = r.entry_id WHERE r.wins > r.losses) AS x WHERE rn = 1""")
def breaking_records(t):
    record = B.prelim_record(t.rounds, t.ballots).select("event_id", "entry_id", "wins", "losses")
    return B.lowest_breaking_record(record.join(_deepest(t), ["event_id", "entry_id"]), ["event_id"])


@query("round_places", """
SELECT event_id, round_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY kind = 'elim', CASE WHEN kind = 'elim' THEN CAST(name AS INTEGER) ELSE 0 END, CAST(name AS INTEGER)) AS INTEGER) AS place
FROM (SELECT DISTINCT event_id, round_id, kind, name FROM rooms) AS r""")
def round_places(t):
    from pyspark.sql import Window
    level = F.element_at(F.create_map(*[F.lit(x) for n, v in (("6", "octo"), ("7", "quarter"), ("8", "semi"), ("9", "first")) for x in (n, v)]), F.col("name"))
    rounds = t.rounds.select("event_id", "round_id", "kind", F.col("name").alias("label"), F.when(F.col("kind") == "elim", level).alias("elim_level"))
    # An event has at most nine rounds.
    return rounds.select("event_id", "round_id", F.row_number().over(Window.partitionBy("event_id").orderBy(*Q.round_order())).alias("place"))


@query("school_aliases", """
SELECT alias, school, n, count(*) OVER (PARTITION BY alias) = 1 AS confident FROM (
  SELECT 'Alias ' || CAST(n AS VARCHAR) AS alias, 'NATION_' || CAST(CASE WHEN supp % 40 = 21 THEN (n + 1) % 25 ELSE n END AS VARCHAR) AS school, CAST(count(*) AS INTEGER) AS n FROM numbered WHERE supp % 4 = 1 GROUP BY ALL) AS x""")
def school_aliases(t):
    s = F.col("supp")
    e = t.entries
    seen = e.select("entry_id", F.concat(F.when(s % 4 == 1, "Alias ").otherwise("NATION_"), _s(_nation())).alias("school_name"))
    said = e.select("entry_id", F.concat(F.lit("NATION_"), _s(F.when(s % 40 == 21, _nation(1)).otherwise(_nation()))).alias("school"),
                    F.lit(False).alias("hybrid"), F.lit(None).cast("string").alias("hybrid_school"))
    return K.discover_aliases(seen, said, _index(t))


@query("match_coverage", """
SELECT event_id AS tournament, CASE WHEN event_id LIKE '%-07-01:%' THEN 'no payload' WHEN supp % 5 = 2 THEN 'unmatched' WHEN supp % 7 = 0 THEN 'ambiguous' ELSE 'matched' END AS status, CAST(count(*) AS INTEGER) AS rows
FROM entries GROUP BY ALL""")
def match_coverage(t):
    s = F.col("supp")
    rows = t.entries.select(F.col("event_id").alias("tournament"), s.alias("row_idx"), "entry_id")
    found = rows.where(F.col("row_idx") % 5 != 2).withColumn("ambiguous", F.col("row_idx") % 7 == 0)
    return K.match_coverage(rows, found, rows.where(~F.col("tournament").like("%-07-01:%")).select("tournament"))


CTES["hand"] = """SELECT tournament_id AS tournament, 'n' || chr(CAST(97 + supp % 26 AS INTEGER)) AS a, 'm' || chr(CAST(97 + (supp // 26) % 26 AS INTEGER)) AS b, CAST(supp % 30 AS INTEGER) AS points, 'S' || CAST(supp % 3 AS VARCHAR) AS school FROM entries"""


@query("manual_results", """
SELECT tournament, pair, arg_min(points, ord) AS points, arg_min(source, ord) AS source FROM (
  SELECT tournament, b || '|' || a AS pair, points, source, {'s': school, 'f': f, 'p': points, 'o': source} AS ord FROM (
    SELECT *, a AS f, 'mail' AS source FROM hand UNION ALL SELECT tournament, a, b, points + 1, school, b, 'call' FROM hand) AS x) AS y GROUP BY ALL""")
def manual_results(t):
    """Each result is written down twice, once with the partners turned round and a point more."""
    s = F.col("supp")
    one, two = F.concat(F.lit("N"), F.char(F.lit(97) + s % 26)), F.concat(F.lit("M"), F.char(F.lit(97) + F.floor(s / 26) % 26))
    row = t.entries.select(F.col("tournament_id").alias("tournament"), F.concat(F.lit("S"), _s(s % 3)).alias("school"), one.alias("one"), two.alias("two"), (s % 30).cast("int").alias("points"))
    first = row.select("tournament", "school", F.col("one").alias("partner1"), F.col("two").alias("partner2"), "points", F.lit("mail").alias("source"))
    second = row.select("tournament", "school", F.col("two").alias("partner1"), F.col("one").alias("partner2"), F.col("points") + 1, F.lit("call").alias("source"))
    return SH.manual_results(first.union(second))
