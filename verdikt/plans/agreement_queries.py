"""Queries over reconciliation, backtests, boards and profiles.

The published side is derived from the same tables: our figures, moved where a
supplier's number says so, so that agreement and disagreement both occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


from verdikt.operators import boards as Q, brackets as B, reconcile as K
from verdikt.operators.lineage import cut_lineage
from verdikt.operators.ranking import weighted_total
from verdikt.plans.driver_tables import DriverTables, loaded_as
from verdikt.plans.rating_queries import _rounded, rated, sides
from verdikt.plans.registry import CTES, query
from verdikt.plans.scoring_queries import entry_results, field_table, scored, speaker_table, team_standings
from verdikt.operators import standings as G

CTES["cases"] = """SELECT r.supp, r.season_id, tournament_id AS tournament, list_extract(['NYPDL', 'CHSSA', 'OSAA', 'Regular'], CAST(supp % 4 + 1 AS INTEGER)) AS category,
    school_id AS school, hybrid_school_id AS hybrid_school, school_id || '::' || coalesce(pair, d1) AS team, coalesce(pair, d1) AS pair, entry_id,
    points::DOUBLE AS ours, greatest(0, points + CASE WHEN supp % 7 = 0 THEN 1 WHEN supp % 11 = 0 THEN -2 ELSE 0 END)::DOUBLE AS theirs,
    points = greatest(0, points + CASE WHEN supp % 7 = 0 THEN 1 WHEN supp % 11 = 0 THEN -2 ELSE 0 END) AS matched,
    supp % 3 = 0 AS broke, hybrid_school_id IS NOT NULL AS hybrid, CAST(supp % 3 - 1 AS INTEGER) AS our_adj,
    CASE WHEN supp % 5 <> 0 THEN CAST(supp % 2 - 1 AS INTEGER) END AS their_adj, supp % 2 = 0 AS same_base,
    list_extract(['exact-initials', 'exact-surnames', 'partial-maverick', 'fuzzy-surname'], CAST(supp % 4 + 1 AS INTEGER)) AS match_tier,
    supp % 29 = 0 AS match_ambiguous, CASE WHEN supp % 17 = 0 THEN 'manual' ELSE 'rounds' END AS provenance, supp % 13 = 0 AS unlisted
  FROM results AS r WHERE division = 'open'"""


def _choose(names: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), i.cast("int"))


def cases(t: DriverTables) -> DataFrame:
    def build() -> DataFrame:
        s = F.col("supp")
        shift = F.when(s % 7 == 0, 1).when(s % 11 == 0, -2).otherwise(0)
        base = entry_results(t).where("division = 'open'").join(t.pairs.drop("people"), "entry_id")
        who = F.coalesce("pair", F.col("student_ids")[0])
        out = base.withColumn("theirs", F.greatest(F.lit(0), F.col("points") + shift).cast("double")).withColumn(
            "ours", F.col("points").cast("double"))
        tiers = ["exact-initials", "exact-surnames", "partial-maverick", "fuzzy-surname"]
        return out.select(
            "supp", "season_id", F.col("tournament_id").alias("tournament"), "tournament_id",
            _choose(["NYPDL", "CHSSA", "OSAA", "Regular"], s % 4).alias("category"), F.col("school_id").alias("school"),
            F.col("hybrid_school_id").alias("hybrid_school"), F.concat_ws("::", "school_id", who).alias("team"), who.alias("pair"),
            "entry_id", F.lit("").alias("partner1"), F.lit("").alias("partner2"), _choose(tiers, s % 4).alias("match_tier"),
            (s % 29 == 0).alias("match_ambiguous"), F.when(s % 17 == 0, "manual").otherwise("rounds").alias("provenance"),
            "ours", "theirs", (F.col("ours") == F.col("theirs")).alias("matched"), (s % 3 == 0).alias("broke"),
            F.col("hybrid_school_id").isNotNull().alias("hybrid"), F.col("ours").alias("our_base"),
            F.when(s % 2 == 0, F.col("ours")).otherwise(F.col("ours") + 1).alias("their_base"),
            (s % 3 - 1).cast("int").alias("our_adj"), F.when(s % 5 != 0, (s % 2 - 1).cast("int")).alias("their_adj"),
            (s % 13 == 0).alias("unlisted"))
    return loaded_as(t, "cases", build)


@query("case_disagreements", """
SELECT entry_id, ours AS our_value, theirs AS official_value, school, match_tier, our_adj, their_adj, broke FROM cases WHERE NOT matched AND NOT unlisted""")
def case_disagreements(t):
    return K.disagreements(cases(t)).select("entry_id", "our_value", "official_value", "detail.school", "detail.match_tier",
                                            "detail.our_adj", "detail.their_adj", "detail.broke")


@query("backtest_points", """
SELECT slice, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE ok) AS INTEGER) AS agree FROM (
  SELECT 'all' AS slice, matched AS ok FROM c0 UNION ALL SELECT 'category: ' || category, matched FROM c0
  UNION ALL SELECT CASE WHEN broke THEN 'result: broke' ELSE 'result: prelims only' END, matched FROM c0
  UNION ALL SELECT 'hybrid', matched FROM c0 WHERE hybrid UNION ALL SELECT 'flagged ambiguous', matched FROM c0 WHERE match_ambiguous
  UNION ALL SELECT 'tier: ' || match_tier, matched FROM c0 UNION ALL SELECT 'component: base', same_base FROM c0 WHERE broke
  UNION ALL SELECT 'component: adjustment', our_adj = their_adj FROM c0 WHERE broke AND their_adj IS NOT NULL) AS x GROUP BY ALL""")
def backtest_points(t):
    return K.backtest_points(cases(t))


CTES["c0"] = "SELECT * FROM cases WHERE NOT unlisted"


@query("worst_tournaments", """
SELECT season_id, tournament, CAST(count(*) FILTER (WHERE NOT matched) AS INTEGER) AS bad, CAST(count(*) AS INTEGER) AS total FROM c0 GROUP BY season_id, tournament
HAVING bad > 0 QUALIFY row_number() OVER (PARTITION BY season_id ORDER BY bad DESC, tournament) <= 12""")
def worst_tournaments(t):
    return K.worst_tournaments(cases(t))


@query("delta_histogram", """
SELECT delta, CAST(count(*) AS INTEGER) AS n, string_agg(entry_id, ',' ORDER BY entry_id) FILTER (WHERE rn <= 3) AS samples FROM (
  SELECT ours - theirs AS delta, entry_id, row_number() OVER (PARTITION BY ours - theirs ORDER BY entry_id) AS rn FROM c0 WHERE NOT matched) AS x GROUP BY delta""")
def delta_histogram(t):
    return K.delta_histogram(cases(t))


CTES["compared"] = """SELECT o.season_id, o.team, o.points, o.n_theirs, CAST(rank() OVER (PARTITION BY o.season_id ORDER BY o.points DESC) AS INTEGER) AS rank, 'R' || replace(split_part(o.team, '::', 1), 'n', '') AS region,
    m.*, round(y.t, 6) AS our_points, round(y.t, 6) - o.points AS delta
  FROM (SELECT season_id, team, round(sum(theirs * weight)::DOUBLE, 6) AS points, CAST(count(*) AS INTEGER) AS n_theirs FROM (
      SELECT season_id, team, theirs, row_number() OVER (PARTITION BY season_id, team ORDER BY theirs DESC, entry_id) AS rn FROM c0 WHERE theirs > 0) AS a JOIN weights AS w ON w.place = a.rn GROUP BY ALL) AS o
  JOIN (SELECT season_id AS sm, team AS tm, CAST(count(*) AS INTEGER) AS n_ours, bool_and(matched) AS all_matched, bool_or(hybrid) AS hybrid, bool_or(broke) AS broke, list_sort(list_distinct(list(category))) AS cats FROM c0 GROUP BY ALL) AS m ON m.sm = o.season_id AND m.tm = o.team
  JOIN (SELECT season_id, team, sum(ours * weight)::DOUBLE AS t FROM (SELECT season_id, team, ours, row_number() OVER (PARTITION BY season_id, team ORDER BY ours DESC, entry_id) AS rn FROM c0) AS a JOIN weights AS w ON w.place = a.rn GROUP BY ALL) AS y
    ON y.season_id = o.season_id AND y.team = o.team"""


def compared(t: DriverTables) -> DataFrame:
    def build() -> DataFrame:
        from verdikt.operators.ranking import competition_rank
        listed = cases(t).where("not unlisted")
        theirs = weighted_total(listed.where("theirs > 0"), ["season_id", "team"], "theirs", ["entry_id"]).withColumnRenamed("tournaments_counted", "n_theirs")
        official = competition_rank(theirs, ["season_id"], "points").withColumn(
            "region", F.concat(F.lit("R"), F.regexp_replace(F.split("team", "::")[0], "n", "")))
        return K.compare_teams(official, cases(t))
    return loaded_as(t, "compared", build)


@query("backtest_teams", """
SELECT season_id, slice, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE abs(delta) <= 0.051) AS INTEGER) AS exact,
  CAST(count(*) FILTER (WHERE abs(delta) <= 0.5) AS INTEGER) AS within_half, CAST(count(*) FILTER (WHERE abs(delta) <= 2.0) AS INTEGER) AS within_two FROM (
  SELECT season_id, 'all' AS slice, delta FROM compared UNION ALL SELECT season_id, 'every result agrees', delta FROM compared WHERE all_matched AND n_ours >= n_theirs
  UNION ALL SELECT season_id, 'tournaments: ' || CAST(n_theirs AS VARCHAR), delta FROM compared WHERE n_theirs BETWEEN 1 AND 5
  UNION ALL SELECT season_id, CASE WHEN rank <= 25 THEN 'tier: top 25' WHEN rank <= 100 THEN 'tier: 26-100' WHEN rank <= 300 THEN 'tier: 101-300' ELSE 'tier: 301+' END, delta FROM compared
  UNION ALL SELECT season_id, 'region: ' || region, delta FROM compared UNION ALL SELECT season_id, CASE WHEN hybrid THEN 'hybrid' ELSE 'single-school' END, delta FROM compared
  UNION ALL SELECT season_id, CASE WHEN broke THEN 'ever broke' ELSE 'prelims only' END, delta FROM compared
  UNION ALL SELECT season_id, 'any ' || unnest(cats), delta FROM compared) AS x GROUP BY season_id, slice HAVING NOT (slice LIKE 'region: %' AND count(*) < 5)""")
def backtest_teams(t):
    return K.backtest_teams(compared(t))


@query("rank_agreement", """
SELECT season_id, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE g = 0) AS INTEGER) AS exact, CAST(count(*) FILTER (WHERE g <= 5) AS INTEGER) AS within_5,
  CAST(count(*) FILTER (WHERE g <= 20) AS INTEGER) AS within_20
FROM (SELECT season_id, abs(row_number() OVER (PARTITION BY season_id ORDER BY our_points DESC, team) - rank() OVER (PARTITION BY season_id ORDER BY points DESC)) AS g FROM compared) AS x GROUP BY ALL""")
def rank_agreement(t):
    return K.rank_agreement(compared(t))


@query("miss_causes", """
SELECT season_id, CASE WHEN n_ours < n_theirs THEN 'missing tournament' WHEN NOT all_matched THEN 'an entry differs' ELSE 'total differs' END AS cause,
  CAST(count(*) AS INTEGER) AS teams FROM compared WHERE abs(delta) > 0.051 GROUP BY ALL""")
def miss_causes(t):
    return K.miss_causes(compared(t))


CTES["runs"] = """SELECT c.*, v.config, CASE v.config WHEN 'sheet' THEN theirs + CASE WHEN supp % 10 = 0 THEN 1 ELSE 0 END WHEN 'walkovers' THEN theirs + CASE WHEN supp % 6 = 0 THEN 1 ELSE 0 END
    WHEN 'fields' THEN theirs + CASE WHEN supp % 4 = 0 THEN 1 ELSE 0 END ELSE theirs + CASE WHEN supp % 6 = 0 OR supp % 8 = 5 THEN 1 ELSE 0 END END AS o2
  FROM cases AS c, (VALUES ('sheet'), ('walkovers'), ('fields'), ('ours')) AS v(config)"""


def runs(t: DriverTables) -> DataFrame:
    s = F.col("supp")
    off = (F.when(F.col("config") == "sheet", s % 10 == 0).when(F.col("config") == "walkovers", s % 6 == 0)
           .when(F.col("config") == "fields", s % 4 == 0).otherwise((s % 6 == 0) | (s % 8 == 5)))
    names = F.explode(F.array(*map(F.lit, ("sheet", "walkovers", "fields", "ours")))).alias("config")
    return cases(t).select("*", names).withColumn("ours", F.col("theirs") + off.cast("int"))


@query("compare_sources", """
SELECT config, slice, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE abs(o2 - theirs) < 0.051) AS INTEGER) AS agree FROM (
  SELECT *, unnest(['all', category]) AS slice FROM runs WHERE provenance = 'rounds' AND NOT unlisted) AS x GROUP BY ALL""")
def compare_sources(t):
    return K.compare_sources(runs(t))


@query("blame_sources", """
SELECT verdict, CASE WHEN verdict = 'lost' THEN coalesce(nullif(c, ''), 'interaction') ELSE '-' END AS cause, CAST(count(*) AS INTEGER) AS n FROM (
  SELECT entry_id, CASE WHEN b AND NOT f THEN 'lost' WHEN NOT b AND f THEN 'gained' END AS verdict, c FROM (
    SELECT entry_id, bool_or(config = 'sheet' AND ok) AS b, bool_or(config = 'ours' AND ok) AS f,
      coalesce(string_agg(config, ' + ' ORDER BY config) FILTER (WHERE config IN ('walkovers', 'fields') AND NOT ok), '') AS c
    FROM (SELECT *, abs(o2 - theirs) < 0.051 AS ok FROM runs WHERE provenance = 'rounds' AND NOT unlisted) AS r GROUP BY entry_id) AS z) AS y
WHERE verdict IS NOT NULL GROUP BY ALL""")
def blame_sources(t):
    return K.blame_sources(runs(t), "sheet", "ours")


def _two_lists(t: DriverTables) -> tuple[DataFrame, DataFrame]:
    s = F.col("supp")
    c = cases(t)
    return c.where(s % 23 != 0), c.where(s % 19 != 1).withColumn("ours", F.col("ours") + (s % 31 == 0).cast("int"))


@query("compare_entries", """
SELECT CASE WHEN b IS NULL AND a > 0 THEN 'lost' WHEN a IS NULL AND b > 0 THEN 'gained' WHEN abs(a - b) > 0.051 THEN 'rescored' ELSE 'same' END AS change,
  CAST(count(*) AS INTEGER) AS entries FROM (SELECT CASE WHEN supp % 23 <> 0 THEN ours END AS a, CASE WHEN supp % 19 <> 1 THEN ours + CASE WHEN supp % 31 = 0 THEN 1 ELSE 0 END END AS b FROM cases) AS x
WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY ALL""")
def compare_entries(t):
    return K.compare_entry_sources(*_two_lists(t))


_TEAM_SUM = "(SELECT season_id, team, round(sum(p * weight)::DOUBLE, 6) AS t FROM (SELECT season_id, team, p, row_number() OVER (PARTITION BY season_id, team ORDER BY p DESC, entry_id) AS rn FROM ({0}) AS i) AS a JOIN weights AS w ON w.place = a.rn GROUP BY ALL)"


@query("compare_entry_totals", f"""
SELECT x.season_id, CASE WHEN y.t IS NULL THEN 'absent' WHEN abs(y.t - x.t) < 0.051 THEN 'identical' ELSE 'moved' END AS change, CAST(count(*) AS INTEGER) AS teams
FROM {_TEAM_SUM.format("SELECT season_id, team, entry_id, ours AS p FROM cases WHERE supp % 23 <> 0 AND ours > 0")} AS x
LEFT JOIN {_TEAM_SUM.format("SELECT season_id, team, entry_id, ours + CASE WHEN supp % 31 = 0 THEN 1 ELSE 0 END AS p FROM cases WHERE supp % 23 <> 0 AND supp % 19 <> 1 AND ours + CASE WHEN supp % 31 = 0 THEN 1 ELSE 0 END > 0")} AS y ON y.season_id = x.season_id AND y.team = x.team GROUP BY ALL""")
def compare_entry_totals(t):
    return K.compare_entry_totals(*_two_lists(t))


@query("check_walkovers", """
SELECT agrees, CAST(count(*) AS INTEGER) AS entries FROM (SELECT entry_id, published = derived AS agrees FROM (
  SELECT entry_id, supp, CAST(sum(CASE WHEN NOT (pair AND panel < round_panel) THEN 0 WHEN sections = 1 THEN -3 WHEN deepest < sections OR (decided > 0 AND maj) THEN -2 ELSE 2 END) AS INTEGER) AS derived,
    CASE WHEN supp % 4 = 0 THEN -2 ELSE 0 END AS published
  FROM (SELECT m.*, min(sections) OVER (PARTITION BY event_id, entry_id) AS deepest FROM main_sides AS m WHERE sections IN (1, 2, 4, 8)) AS x GROUP BY ALL) AS q) AS z GROUP BY ALL""")
def check_walkovers(t):
    s = cut_lineage(B.bracket_sides(cut_lineage(B.main_bracket(t.rounds, t.ballots)), t.ballots, t.entries))
    derived = B.walkover_adjustment(s, B.elim_depth(s))
    said = t.entries.select("entry_id", F.when(F.col("supp") % 4 == 0, -2).alias("walkover_adjustment"))
    return K.check_walkovers(derived, said).groupBy("agrees").agg(F.count("*").cast("int").alias("entries"))


def _paired(t: DriverTables) -> DataFrame:
    c = compared(t)
    return c.select("season_id", F.lit("teams").alias("scope"), "rank", F.col("team").alias("label"), F.col("points").alias("official"),
                    F.when(F.col("rank") % 9 != 0, F.col("our_points")).alias("ours"))


_PAIRED = "(SELECT season_id, 'teams' AS scope, rank, team AS label, points AS official, CASE WHEN rank % 9 <> 0 THEN our_points END AS ours FROM compared)"


@query("compare_top", f"""
SELECT season_id, scope, CAST(count(*) AS INTEGER) AS compared, CAST(count(*) FILTER (WHERE ours IS NULL) AS INTEGER) AS unmatched, CAST(count(*) FILTER (WHERE g < 0.051) AS INTEGER) AS exact,
  CAST(count(*) FILTER (WHERE 100 * g / official <= 0.5) AS INTEGER) AS within_half_pct, CAST(count(*) FILTER (WHERE 100 * g / official <= 2) AS INTEGER) AS within_two_pct,
  CAST(count(*) FILTER (WHERE g <= 0.5) AS INTEGER) AS within_half, CAST(count(*) FILTER (WHERE g <= 2) AS INTEGER) AS within_two
FROM (SELECT *, abs(ours - official) AS g FROM {_PAIRED} AS p WHERE rank <= 100) AS x GROUP BY season_id, scope""")
def compare_top(t):
    return K.compare_top(_paired(t))


@query("largest_gaps", f"""
SELECT season_id, scope, label, round(official, 6) AS official, round(ours, 6) AS ours, round(ours - official, 6) AS gap FROM {_PAIRED} AS p WHERE rank <= 100 AND abs(ours - official) >= 0.051
QUALIFY row_number() OVER (PARTITION BY season_id, scope ORDER BY round(abs(p.ours - p.official), 6) DESC, label) <= 8""")
def largest_gaps(t):
    return _rounded(K.largest_gaps(_paired(t)))


@query("diagnose", f"""
SELECT x.season_id, problem, CAST(count(*) AS INTEGER) AS rows, CAST(count(DISTINCT b.team) AS INTEGER) AS teams, round(coalesce(sum(b.stake / n), 0), 6) AS points FROM (
  SELECT season_id, problem, team, count(*) OVER (PARTITION BY season_id, problem, team) AS n FROM (
    SELECT season_id, 'scored differently' AS problem, team FROM cases WHERE NOT matched UNION ALL SELECT season_id, 'never matched', team FROM cases WHERE supp % 21 = 2
    UNION ALL SELECT season_id, 'ambiguous', team FROM cases WHERE match_ambiguous UNION ALL SELECT DISTINCT season_id, 'no usable payload', tournament FROM cases WHERE tournament LIKE '%-07-01'
    UNION ALL SELECT season_id, CASE WHEN ours IS NULL THEN 'absent from our standings' ELSE 'total differs only' END, label FROM {_PAIRED} AS p
      WHERE rank <= 100 AND (ours IS NULL OR abs(ours - official) >= 0.051) AND (season_id, label) NOT IN (SELECT (season_id, team) FROM cases WHERE NOT matched OR supp % 21 = 2)) AS r) AS x
LEFT JOIN (SELECT season_id, label AS team, abs(coalesce(ours - official, official)) AS stake FROM {_PAIRED} AS p WHERE rank <= 100 AND (ours IS NULL OR abs(ours - official) >= 0.051)) AS b ON b.season_id = x.season_id AND b.team = x.team
GROUP BY x.season_id, problem""")
def diagnose(t):
    c, s = cases(t), F.col("supp")
    teams = _paired(t).where("rank <= 100").withColumn("delta", F.col("ours") - F.col("official")).withColumnRenamed("label", "team_key")
    return _rounded(K.diagnose(c, c.where(s % 21 == 2).select("season_id", "tournament", "team"), c.where("match_ambiguous").select("season_id", "tournament", "team"),
                               c.where(F.col("tournament").like("%-07-01")).select("season_id", "tournament"), teams))


@query("audit_top", """
SELECT c.season_id, c.team, c.tournament, c.theirs AS points, m.ours, CASE WHEN m.ours IS NOT NULL THEN CASE WHEN m.ours = c.theirs THEN 'agrees' ELSE 'scored differently' END
  WHEN c.supp % 21 = 2 THEN 'not matched' WHEN c.tournament LIKE '%-07-01' THEN 'no payload' ELSE 'absent' END AS cause
FROM cases AS c LEFT JOIN (SELECT season_id, team, tournament, arg_max(ours, entry_id) AS ours FROM cases WHERE supp % 5 <> 2 GROUP BY ALL) AS m ON m.season_id = c.season_id AND m.team = c.team AND m.tournament = c.tournament
WHERE EXISTS (SELECT 1 FROM compared AS d WHERE d.season_id = c.season_id AND d.team = c.team AND abs(d.delta) > 0.051)""")
def audit_top(t):
    c, s = cases(t), F.col("supp")
    bad = compared(t).where("abs(delta) > 0.051").select("season_id", F.col("team").alias("team_key"))
    results = c.select("season_id", F.col("team").alias("team_key"), "tournament", "entry_id", F.lit("").alias("result"), F.col("theirs").alias("points"))
    return K.audit_top(bad, results, c.where(s % 5 != 2), c.where(s % 21 == 2).select("season_id", "team", "tournament", "entry_id"),
                       c.where(F.col("tournament").like("%-07-01")).select("tournament")).drop("result")


@query("forfeit_rule_sweep", """
SELECT rule, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE g = 0) AS INTEGER) AS exact, CAST(count(*) FILTER (WHERE g <= 1) AS INTEGER) AS within_one, round(avg(g), 6) AS mean_error FROM (
  SELECT rule, f.tournament_id, abs(count(*) FILTER (WHERE NOT (CASE WHEN drops THEN dropped ELSE FALSE END OR (least_missed IS NOT NULL AND ok AND missed >= least_missed))) - any_value(p.open_field)) AS g FROM (
    SELECT e.tournament_id, e.dropped, coalesce(a.ok, FALSE) AS ok, v.*, CASE v.basis WHEN 'missing' THEN np.n - coalesce(b.scored, 0) WHEN 'byeaware' THEN np.n - coalesce(b.scored, 0) - coalesce(b.byes, 0) ELSE coalesce(b.appeared, 0) - coalesce(b.scored, 0) END AS missed
    FROM entries AS e LEFT JOIN (SELECT event_id, entry_id, count(*) AS appeared, count(won) AS scored, count(*) FILTER (WHERE won IS NULL AND is_bye) AS byes FROM ballots WHERE kind = 'prelim' GROUP BY ALL) AS b ON b.entry_id = e.entry_id
    JOIN (SELECT event_id, count(DISTINCT round_id) AS n FROM rooms WHERE kind = 'prelim' GROUP BY ALL) AS np ON np.event_id = e.event_id
    LEFT JOIN (SELECT event_id, count(won) > 0 AS ok FROM ballots WHERE kind = 'prelim' GROUP BY ALL) AS a ON a.event_id = e.event_id,
    (VALUES ('A', 'missing', 2, FALSE), ('B', 'missing', 2, TRUE), ('C', 'missing', 3, FALSE), ('D', 'appeared', 2, FALSE), ('E', 'appeared', 2, TRUE), ('F', 'appeared', 1, TRUE), ('G', 'byeaware', 2, FALSE),
      ('H', 'byeaware', 2, TRUE), ('I', 'byeaware', 3, TRUE), ('J', 'missing', 3, TRUE), ('K', 'none', NULL, TRUE), ('L', 'byeaware', 2, TRUE)) AS v(rule, basis, least_missed, drops)
    WHERE e.division = 'open') AS f
  JOIN (SELECT tournament_id, count(*) - 2 AS open_field FROM entries WHERE division = 'open' GROUP BY ALL) AS p ON p.tournament_id = f.tournament_id GROUP BY rule, f.tournament_id) AS x GROUP BY rule""")
def forfeit_rule_sweep(t):
    e = t.entries.where("division = 'open'").select("tournament_id", "event_id", "entry_id", "dropped")
    said = e.groupBy("tournament_id").agg((F.count("*") - 2).alias("open_field"))
    return _rounded(K.forfeit_rule_sweep(e, t.rounds, t.ballots, said))


@query("forfeit_inspection", """
SELECT e.event_id, e.entry_id, e.dropped, CAST(coalesce(b.scored, 0) AS INTEGER) AS scored, CAST(coalesce(b.byes, 0) AS INTEGER) AS byes, CAST(len(ab) AS INTEGER) AS absent,
  CAST(np.n - coalesce(b.scored, 0) - coalesce(b.byes, 0) AS INTEGER) AS missing, array_to_string(list_sort(ab), ',') AS absent_rounds
FROM (SELECT e.*, list_filter(p.names, lambda x: NOT list_contains(coalesce(h.here, []), x)) AS ab FROM entries AS e JOIN (SELECT event_id, list_sort(list_distinct(list(name))) AS names FROM rooms WHERE kind = 'prelim' GROUP BY ALL) AS p ON p.event_id = e.event_id
      LEFT JOIN (SELECT entry_id, list_distinct(list(name)) AS here FROM ballots WHERE kind = 'prelim' GROUP BY ALL) AS h ON h.entry_id = e.entry_id) AS e
JOIN (SELECT event_id, count(DISTINCT round_id) AS n FROM rooms WHERE kind = 'prelim' GROUP BY ALL) AS np ON np.event_id = e.event_id
LEFT JOIN (SELECT entry_id, count(won) AS scored, count(*) FILTER (WHERE won IS NULL AND is_bye) AS byes FROM ballots WHERE kind = 'prelim' GROUP BY ALL) AS b ON b.entry_id = e.entry_id
WHERE np.n - coalesce(b.scored, 0) - coalesce(b.byes, 0) > 0""")
def forfeit_inspection(t):
    return K.forfeit_inspection(t.entries, t.rounds, t.ballots)


@query("category_deltas", """
SELECT category, tournament, ours - theirs AS delta, CAST(count(*) AS INTEGER) AS n FROM cases WHERE NOT matched GROUP BY ALL""")
def category_deltas(t):
    return K.category_deltas(cases(t))


@query("trace_entries", """
SELECT c.tournament, c.pair, CASE WHEN c.supp % 7 = 0 THEN '9-9' ELSE CAST(r.wins AS VARCHAR) || '-' || CAST(r.losses AS VARCHAR) END AS result,
  CAST(r.wins AS VARCHAR) || '-' || CAST(r.losses AS VARCHAR) AS derived, c.supp % 7 = 0 AS differs FROM cases AS c JOIN results AS r ON r.entry_id = c.entry_id""")
def trace_entries(t):
    rec = entry_results(t).where("division = 'open'").select("entry_id", "supp", "wins", "losses").join(
        cases(t).select("entry_id", "tournament", "pair"), "entry_id")
    # A pair may stand behind several entries of a tournament, so the entry tells their rows apart.
    rec = rec.withColumn("pair", F.concat_ws("#", "pair", "entry_id"))
    derived = F.concat_ws("-", F.col("wins").cast("string"), F.col("losses").cast("string"))
    rows = rec.select("tournament", "pair", F.when(F.col("supp") % 7 == 0, "9-9").otherwise(derived).alias("result"))
    return K.trace_entries(rows, rec.withColumn("elim_level", F.lit("-"))).drop("elim_level").withColumn("pair", F.split("pair", "#")[0])


@query("field_deltas", """
SELECT tournament_id, ours, theirs, ours - theirs AS delta FROM (SELECT tournament_id, count(*) AS ours, count(*) - CASE WHEN month(any_value(CAST(tournament_id AS DATE))) = 4 THEN 0 ELSE 3 END AS theirs
  FROM entries WHERE division = 'open' GROUP BY ALL) AS x WHERE ours <> theirs""")
def field_deltas(t):
    ours = t.entries.where("division = 'open'").groupBy("tournament_id").agg(F.count("*").alias("open_field"))
    shift = F.when(F.month(F.to_date("tournament_id")) == 4, 0).otherwise(3)
    return K.field_deltas(ours, ours.withColumn("open_field", F.col("open_field") - shift))


@query("backtest_fields", """
SELECT figure, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE ours = theirs) AS INTEGER) AS agree FROM (
  SELECT 'open_field' AS figure, o AS ours, o - k AS theirs FROM z UNION ALL SELECT 'njv_field', n, CASE WHEN k = 0 THEN 0 ELSE n END FROM z
  UNION ALL SELECT 'afs', o + n, o + n FROM z UNION ALL SELECT 'elim_field', ef, CASE WHEN k = 1 THEN ef END FROM z
  UNION ALL SELECT 'prelim_count', pc, pc + k FROM z) AS x WHERE theirs IS NOT NULL GROUP BY figure""")
def backtest_fields(t):
    ours = K.backtest_figures(t.events, field_table(t))
    k = F.when(F.month(F.to_date("tournament_id")) == 4, 0).otherwise(1)
    said = ours.withColumns({"open_field": F.col("open_field") - k, "njv_field": F.when(k == 1, F.col("njv_field")),
                             "elim_field": F.when(k == 1, F.col("elim_field")), "prelim_count": F.col("prelim_count") + k})
    return K.backtest_fields(ours, said)


CTES["z"] = """SELECT e.tournament_id, sum(raw_entries - forfeited_out) FILTER (WHERE division = 'open') AS o,
    coalesce(sum(raw_entries - forfeited_out) FILTER (WHERE division = 'novice'), 0) AS n, sum(elim_field) FILTER (WHERE division = 'open') AS ef,
    max(prelim_count) FILTER (WHERE division = 'open') AS pc, CASE WHEN month(CAST(e.tournament_id AS DATE)) = 4 THEN 0 ELSE 1 END AS k
  FROM fs JOIN (SELECT DISTINCT event_id, tournament_id, division FROM rooms) AS e ON e.event_id = fs.event_id
  GROUP BY e.tournament_id HAVING sum(raw_entries) FILTER (WHERE division = 'open') IS NOT NULL"""

CTES["diag_teams"] = """SELECT t.season_id, t.pair, t.rank AS official_rank, t.points + CASE WHEN x % 5 = 0 THEN 1 ELSE 0 END AS official_points,
    CASE WHEN x % 7 <> 0 THEN t.points END AS our_points FROM (SELECT *, CAST(replace(split_part(pair, '|', 1), 'd', '') AS INTEGER) + CAST(replace(split_part(pair, '|', 2), 'd', '') AS INTEGER) AS x FROM team_totals) AS t"""
CTES["diag_results"] = """SELECT coalesce(o.season_id, m.season_id) AS season_id, coalesce(o.pair, m.pair) AS pair, coalesce(o.tournament, m.tournament) AS tournament, o.official, m.ours,
    m.ours - o.official AS delta, coalesce(o.counted, FALSE) AS counted, CASE WHEN m.ours IS NULL THEN 'missing' ELSE 'rounds' END AS provenance
  FROM (SELECT season_id, pair, tournament, arg_min(official, entry_id) AS official, arg_min(rn <= 5, entry_id) AS counted FROM (
      SELECT season_id, pair, tournament_id AS tournament, entry_id, (points + CASE WHEN supp % 7 = 0 THEN 1 ELSE 0 END)::DOUBLE AS official,
        row_number() OVER (PARTITION BY season_id, pair ORDER BY points + CASE WHEN supp % 7 = 0 THEN 1 ELSE 0 END DESC, entry_id) AS rn FROM counting WHERE supp % 9 <> 0) AS q GROUP BY ALL) AS o
  FULL OUTER JOIN (SELECT c.season_id, c.pair, c.tournament_id AS tournament, max(c.points)::DOUBLE AS ours FROM counting AS c JOIN diag_teams AS d ON d.season_id = c.season_id AND d.pair = c.pair AND d.our_points IS NOT NULL
      WHERE c.supp % 8 <> 0 GROUP BY ALL) AS m
    ON m.season_id = o.season_id AND m.pair = o.pair AND m.tournament = o.tournament"""


def diagnostics(t: DriverTables) -> DataFrame:
    def build() -> DataFrame:
        num = lambda i: F.regexp_replace(F.split("pair", r"\|")[i], "d", "").cast("int")
        totals = team_standings(t)
        teams = totals.withColumn("x", num(0) + num(1)).select(
            "season_id", F.col("pair").alias("team_key"), F.when(F.col("x") % 7 != 0, F.concat_ws("_", F.lit("team"), "season_id", "pair")).alias("team_id"),
            F.col("rank").alias("official_rank"), (F.col("points") + (F.col("x") % 5 == 0).cast("int")).alias("official_points"),
            F.when(F.col("x") % 7 != 0, F.col("points")).alias("our_points"))
        s = F.element_at(F.split("entry_id", ":"), -1).cast("int")
        mine = scored(t).join(t.pairs.where("pair is not null").select("entry_id", "pair"), "entry_id").withColumn("s", s)
        theirs = mine.where("s % 9 <> 0").select(
            "season_id", F.col("pair").alias("team_key"), F.col("tournament_id").alias("tournament"),
            (F.col("points") + (F.col("s") % 7 == 0).cast("int")).cast("double").alias("points"), F.col("entry_id").alias("order"))
        ours = mine.where("s % 8 <> 0").select(
            "season_id", F.concat_ws("_", F.lit("team"), "season_id", "pair").alias("team_id"), F.col("tournament_id").alias("tournament"),
            F.col("points").cast("double").alias("points"), F.lit("rounds").alias("provenance"))
        return K.standing_diagnostics(teams, theirs, ours)
    return loaded_as(t, "diagnostics", build)


@query("standing_diagnostics", "SELECT season_id, pair AS team_key, tournament, official, ours, delta, counted, provenance FROM diag_results")
def standing_diagnostics(t):
    return diagnostics(t).select("season_id", "team_key", F.explode("results").alias("r")).select(
        "season_id", "team_key", "r.tournament", "r.official", "r.ours", "r.delta", "r.counted", "r.provenance")


@query("diagnostics_worst", """
SELECT season_id, pair AS team_key, official_rank, official_points, our_points, round(our_points - official_points, 6) AS delta FROM diag_teams
WHERE our_points IS NULL OR abs(our_points - official_points) >= 0.051
QUALIFY row_number() OVER (PARTITION BY season_id ORDER BY our_points IS NULL DESC, round(abs(our_points - official_points), 6) DESC NULLS FIRST, pair) <= 200""")
def diagnostics_worst(t):
    return Q.diagnostics_worst(diagnostics(t).withColumn("delta", F.round("delta", 6))).select(
        "season_id", "team_key", "official_rank", "official_points", "our_points", "delta")


@query("diagnostics_summary", """
SELECT season_id, CAST(count(*) AS INTEGER) AS total, CAST(count(*) FILTER (WHERE abs(our_points - official_points) < 0.051) AS INTEGER) AS exact,
  CAST(count(*) FILTER (WHERE abs(our_points - official_points) >= 0.051) AS INTEGER) AS differ, CAST(count(*) FILTER (WHERE our_points IS NULL) AS INTEGER) AS missing FROM diag_teams GROUP BY ALL""")
def diagnostics_summary(t):
    return Q.diagnostics_summary(diagnostics(t))


@query("agreement", """
SELECT season_id, 1 AS ord, 'Per-entry results' AS label, CAST(count(*) FILTER (WHERE abs(official - ours) < 0.051) AS INTEGER) AS agree, CAST(count(*) FILTER (WHERE abs(official - ours) >= 0.051) AS INTEGER) AS differ,
  CAST(count(*) FILTER (WHERE ours IS NULL) AS INTEGER) AS absent FROM diag_results WHERE official IS NOT NULL GROUP BY ALL
UNION ALL SELECT season_id, 2, 'Partnership season totals', CAST(count(*) FILTER (WHERE abs(our_points - official_points) < 0.051) AS INTEGER), CAST(count(*) FILTER (WHERE abs(our_points - official_points) >= 0.051) AS INTEGER), CAST(count(*) FILTER (WHERE our_points IS NULL) AS INTEGER) FROM diag_teams GROUP BY ALL
UNION ALL SELECT season_id, 3, 'Top 100 partnerships', CAST(count(*) FILTER (WHERE abs(our_points - official_points) < 0.051) AS INTEGER), CAST(count(*) FILTER (WHERE abs(our_points - official_points) >= 0.051) AS INTEGER), CAST(count(*) FILTER (WHERE our_points IS NULL) AS INTEGER) FROM diag_teams WHERE official_rank <= 100 GROUP BY ALL
UNION ALL SELECT season_id, 4, 'Top 100, within two points', CAST(count(*) FILTER (WHERE abs(our_points - official_points) <= 2) AS INTEGER), CAST(count(*) FILTER (WHERE abs(our_points - official_points) > 2) AS INTEGER), CAST(count(*) FILTER (WHERE our_points IS NULL) AS INTEGER) FROM diag_teams WHERE official_rank <= 100 GROUP BY ALL""")
def agreement(t):
    return Q.agreement(diagnostics(t))


@query("tournament_diagnostics", """
SELECT season_id, tournament, CAST(count(*) AS INTEGER) AS differing, sum(abs(coalesce(delta, official, 0))) AS points FROM diag_results WHERE ours IS NULL OR delta <> 0
GROUP BY season_id, tournament QUALIFY row_number() OVER (PARTITION BY season_id ORDER BY differing DESC, tournament) <= 20""")
def tournament_diagnostics(t):
    return Q.tournament_diagnostics(diagnostics(t))


_STATE = "(SELECT t.*, d.official_points, CASE WHEN d.our_points IS NULL THEN 'pending' WHEN abs(d.our_points - d.official_points) > 0.05 THEN 'differs' ELSE 'agrees' END AS state, abs(coalesce(d.our_points - d.official_points, 0)) AS gap, d.our_points IS NULL AS nolink FROM team_totals AS t JOIN diag_teams AS d ON d.season_id = t.season_id AND d.pair = t.pair)"
_SETTLED = "CASE WHEN any_differs AND coalesce(exposure, 0) >= 0.01 * points THEN 'differs' WHEN any_pending THEN 'pending' ELSE 'agrees' END"


@query("team_board", f"""
SELECT t.season_id, t.rank, t.points, coalesce(s.short_name, s.name) AS school, s.region, a.shown AS debater1, b.shown AS debater2, a.debater_id AS debater1_id, b.debater_id AS debater2_id, t.tournaments_counted AS tournaments,
  CAST(coalesce(qa.auto_qualified::INT, 0) + coalesce(qb.auto_qualified::INT, 0) AS INTEGER) AS partners_qualified,
  CASE coalesce(qa.auto_qualified::INT, 0) + coalesce(qb.auto_qualified::INT, 0) WHEN 2 THEN 'AQ' WHEN 1 THEN 'AL' END AS mark,
  CASE WHEN t.nolink THEN NULL ELSE t.official_points END AS official_points, t.state AS reconciliation
FROM {_STATE} AS t JOIN people AS a ON a.debater_id = split_part(t.pair, '|', 1) JOIN people AS b ON b.debater_id = split_part(t.pair, '|', 2)
LEFT JOIN home AS h ON h.season_id = t.season_id AND h.pair = t.pair LEFT JOIN schools AS s ON s.school_id = h.school_id
LEFT JOIN debater_totals AS qa ON qa.season_id = t.season_id AND qa.debater_id = a.debater_id LEFT JOIN debater_totals AS qb ON qb.season_id = t.season_id AND qb.debater_id = b.debater_id""")
def team_board(t):
    return Q.team_board(team_standings(t), t.people, t.schools, G.debater_totals(scored(t), t.pairs), diagnostics(t))


@query("debater_board", f"""
SELECT d.season_id, d.debater_id, d.rank, d.points, p.shown AS name, coalesce(s.short_name, s.name) AS school, s.region, d.auto_qualified, {_SETTLED} AS reconciliation, coalesce(x.exposure, 0) AS exposure
FROM debater_totals AS d JOIN people AS p ON p.debater_id = d.debater_id LEFT JOIN schools AS s ON s.school_id = p.school_id
LEFT JOIN (SELECT season_id, debater_id, sum(gap) AS exposure, bool_or(state = 'differs') AS any_differs, bool_or(state = 'pending') AS any_pending FROM (
  SELECT season_id, split_part(pair, '|', 1) AS debater_id, state, gap FROM {_STATE} AS q UNION ALL SELECT season_id, split_part(pair, '|', 2), state, gap FROM {_STATE} AS q) AS y GROUP BY ALL) AS x
  ON x.season_id = d.season_id AND x.debater_id = d.debater_id""")
def debater_board(t):
    return Q.debater_board(G.debater_totals(scored(t), t.pairs), team_standings(t), t.people, t.schools, diagnostics(t))


@query("school_board", f"""
SELECT d.season_id, d.school_id, d.rank, d.points, coalesce(s.short_name, s.name) AS name, s.region, {_SETTLED} AS reconciliation, coalesce(x.exposure, 0) AS exposure
FROM school_totals AS d JOIN schools AS s ON s.school_id = d.school_id
LEFT JOIN (SELECT q.season_id, h.school_id, sum(gap) AS exposure, bool_or(state = 'differs') AS any_differs, bool_or(state = 'pending') AS any_pending
  FROM {_STATE} AS q JOIN home AS h ON h.season_id = q.season_id AND h.pair = q.pair GROUP BY ALL) AS x ON x.season_id = d.season_id AND x.school_id = d.school_id""")
def school_board(t):
    return Q.school_board(G.school_totals(scored(t), t.members), team_standings(t), t.schools, diagnostics(t))


def speakers(t: DriverTables) -> DataFrame:
    return loaded_as(t, "speaker_table", lambda: speaker_table(t))


@query("speaker_board", """
SELECT s.season_id, s.person_id, s.rank, ballots, round(mean_z, 6) AS mean_z, p.shown AS name, coalesce(c.short_name, c.name) AS school, c.region
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY season_id ORDER BY mean_z DESC, person_id) AS INTEGER) AS rank FROM speakers WHERE ballots >= 20) AS s
JOIN people AS p ON p.debater_id = s.person_id LEFT JOIN schools AS c ON c.school_id = p.school_id""")
def speaker_board(t):
    return _rounded(Q.speaker_board(speakers(t), t.people, t.schools).select(
        "season_id", "person_id", "rank", "ballots", "mean_z", "name", "school", "region"))


@query("speaker_summary", """
SELECT a.season_id, a.ranked, a.total, a.ranked_ballots, b.scores, b.excluded, coalesce(j.avg_judges, 0) AS avg_judges FROM (
  SELECT season_id, CAST(count(*) FILTER (WHERE ballots >= 20) AS INTEGER) AS ranked, CAST(count(*) AS INTEGER) AS total, CAST(coalesce(sum(ballots) FILTER (WHERE ballots >= 20), 0) AS INTEGER) AS ranked_ballots FROM speakers GROUP BY ALL) AS a
JOIN (SELECT season_id, CAST(count(*) FILTER (WHERE ok) AS INTEGER) AS scores, CAST(count(*) FILTER (WHERE NOT ok) AS INTEGER) AS excluded FROM (
  SELECT season_id, NOT (raw = 0) AND raw BETWEEN lo - (30 - lo) AND 30 + (30 - lo) * 0.1::DOUBLE AS ok FROM line_scores WHERE division = 'open') AS l GROUP BY ALL) AS b ON b.season_id = a.season_id
LEFT JOIN (SELECT season_id, CAST(round(avg(n)) AS INTEGER) AS avg_judges FROM (SELECT u.season_id, u.debater_id, count(DISTINCT judge_id) AS n FROM usable AS u JOIN speakers AS s ON s.season_id = u.season_id AND s.person_id = u.debater_id AND s.ballots >= 20 JOIN people AS p ON p.debater_id = u.debater_id GROUP BY ALL) AS q GROUP BY ALL) AS j ON j.season_id = a.season_id""")
def speaker_summary(t):
    from verdikt.operators import speaks as S
    scores = S.usable_scores(t.scores).select("season_id", "debater_id", "judge_id", F.col("canonical").alias("z"), "excluded")
    return Q.speaker_summary(speakers(t), scores, t.canon)


@query("season_summary", """
SELECT t.season_id, t.n AS tournaments, coalesce(a.n, 0) AS teams, coalesce(d.n, 0) AS debaters, b.n AS ballots, coalesce(x.n, 0) AS disagreements FROM (SELECT season_id, count(*) AS n FROM tournaments GROUP BY ALL) AS t
LEFT JOIN (SELECT season_id, count(*) AS n FROM team_totals GROUP BY ALL) AS a ON a.season_id = t.season_id LEFT JOIN (SELECT season_id, count(*) AS n FROM debater_totals GROUP BY ALL) AS d ON d.season_id = t.season_id
JOIN (SELECT season_id, count(*) AS n FROM ballots GROUP BY ALL) AS b ON b.season_id = t.season_id LEFT JOIN (SELECT season_id, count(*) AS n FROM cases WHERE NOT matched AND NOT unlisted GROUP BY ALL) AS x ON x.season_id = t.season_id""")
def season_summary(t):
    return Q.season_summary(t.tournaments, team_standings(t), G.debater_totals(scored(t), t.pairs), t.ballots,
                            cases(t).where("not matched and not unlisted"))


CTES["figs"] = """SELECT season_id, subject, 1500 + 20.0::DOUBLE * (2 * w - n) AS rating, greatest(60.0::DOUBLE, 350.0::DOUBLE / sqrt(n)) AS deviation, n AS rounds_counted FROM (
    SELECT season_id, subject, count(*) AS n, sum(w) AS w FROM (SELECT season_id, a AS subject, CASE WHEN 2 * won_a > ballots THEN 1 ELSE 0 END AS w FROM rated
    UNION ALL SELECT season_id, b, CASE WHEN 2 * won_a > ballots THEN 0 ELSE 1 END FROM rated) AS x GROUP BY ALL) AS y"""


def ratings(t: DriverTables) -> DataFrame:
    """Rating rows with closed-form figures: a current row per pair and one per tournament debated."""
    from verdikt.plans.rating_queries import figures
    now = figures(t).select("season_id", "subject", F.lit(None).cast("string").alias("tournament_id"), "rating", "deviation",
                            F.col("rating").alias("shrunk_rating"), F.col("rounds").alias("rounds_counted"))
    past = (rated(t).select("season_id", "tournament_id", F.explode(F.array("a", "b")).alias("subject"))
            .groupBy("season_id", "tournament_id", "subject").agg(F.count("*").alias("rounds_counted"))
            .withColumns({"rating": F.lit(1500.0), "deviation": F.lit(350.0), "shrunk_rating": F.lit(1500.0)}))
    return now.unionByName(past)


@query("rating_board", """
SELECT f.season_id, f.subject, a.shown AS debater1, b.shown AS debater2, coalesce(s.short_name, s.name) AS school, s.region, f.rating, round(f.deviation, 6) AS deviation, f.rating AS shrunk, f.rounds_counted AS rounds, t.rank AS points_rank, t.points
FROM figs AS f JOIN people AS a ON a.debater_id = split_part(f.subject, '|', 1) JOIN people AS b ON b.debater_id = split_part(f.subject, '|', 2)
LEFT JOIN team_totals AS t ON t.season_id = f.season_id AND t.pair = f.subject LEFT JOIN home AS h ON h.season_id = f.season_id AND h.pair = f.subject
LEFT JOIN schools AS s ON s.school_id = coalesce(h.school_id, a.school_id) WHERE f.rounds_counted >= 5""")
def rating_board(t):
    return Q.rating_board(ratings(t), t.people, team_standings(t), t.schools).withColumn("deviation", F.round("deviation", 6))


@query("rating_summary", """
SELECT f.season_id, CAST(count(*) FILTER (WHERE rounds_counted >= 5) AS INTEGER) AS ranked, CAST(count(*) AS INTEGER) AS total, CAST(coalesce(sum(rounds_counted) FILTER (WHERE rounds_counted >= 5), 0) // 2 AS INTEGER) AS ranked_rounds,
  CAST(any_value(p.n) AS INTEGER) AS periods FROM figs AS f JOIN (SELECT season_id, count(DISTINCT tournament_id) AS n FROM rated GROUP BY ALL) AS p ON p.season_id = f.season_id GROUP BY f.season_id""")
def rating_summary(t):
    return Q.rating_summary(ratings(t))


@query("rating_method_figures", """
SELECT c.season_id, CAST(c.n AS INTEGER) AS partnerships, CAST(p.n AS INTEGER) AS periods, CAST(c.r // 2 AS INTEGER) AS rounds, round(coalesce(m.tau, 350), 6) AS tau, coalesce(m.n, 0) AS measured, round(w.opp, 6) AS opp_win_pct,
  round(173.7178::DOUBLE * ln((1 - w.opp / 100) / (w.opp / 100)), 6) AS side_advantage FROM (SELECT season_id, count(*) AS n, sum(rounds_counted) AS r FROM figs GROUP BY ALL) AS c
JOIN (SELECT season_id, count(DISTINCT tournament_id) AS n FROM rated GROUP BY ALL) AS p ON p.season_id = c.season_id
LEFT JOIN (SELECT season_id, count(*) AS n, sqrt(greatest(var_pop(rating) - avg(deviation * deviation), var_pop(rating) * 0.05::DOUBLE)) AS tau FROM figs WHERE rounds_counted >= 10 GROUP BY ALL) AS m ON m.season_id = c.season_id
JOIN (SELECT season_id, 100.0::DOUBLE * count(*) FILTER (WHERE side = 2) / count(*) AS opp FROM sides WHERE NOT is_bye AND decided > 0 AND won * 2 > decided GROUP BY ALL) AS w ON w.season_id = c.season_id""")
def rating_method_figures(t):
    return _rounded(Q.rating_method_figures(ratings(t), sides(t)))


@query("profile_partnerships", """
SELECT b.season_id, b.subject, x.person_id, x.partner_id, p.shown AS partner, b.rating, round(b.deviation, 6) AS deviation, b.rating AS shrunk, b.rounds_counted AS rounds, r.rk AS rating_rank, t.points
FROM figs AS b JOIN (SELECT DISTINCT season_id, subject, split_part(subject, '|', 1) AS person_id, split_part(subject, '|', 2) AS partner_id FROM figs UNION SELECT season_id, subject, split_part(subject, '|', 2), split_part(subject, '|', 1) FROM figs) AS x ON x.season_id = b.season_id AND x.subject = b.subject
LEFT JOIN (SELECT season_id, subject, rank() OVER (PARTITION BY season_id ORDER BY rating DESC) AS rk FROM figs WHERE rounds_counted >= 5) AS r ON r.season_id = b.season_id AND r.subject = b.subject
LEFT JOIN team_totals AS t ON t.season_id = b.season_id AND t.pair = b.subject LEFT JOIN people AS p ON p.debater_id = x.partner_id""")
def profile_partnerships(t):
    return Q.profile_partnerships(ratings(t), team_standings(t), t.people).withColumn("deviation", F.round("deviation", 6))


@query("board_order", """
SELECT season_id, subject, CAST(row_number() OVER (PARTITION BY season_id ORDER BY floor(rating + 0.5) DESC, deviation, rounds_counted DESC, subject) AS INTEGER) AS position FROM figs""")
def board_order(t):
    now = Q.current_ratings(ratings(t))
    return Q.board_order(now, F.floor(F.col("rating") + 0.5).cast("double"), "deviation", "rounds_counted", "subject", ["season_id"]).select(
        "season_id", "subject", "position")


@query("name_search", """
SELECT d.season_id, d.debater_id, d.rank FROM debater_totals AS d JOIN people AS p ON p.debater_id = d.debater_id LEFT JOIN schools AS s ON s.school_id = p.school_id
WHERE lower(p.shown) LIKE '%qa%' OR lower(coalesce(s.short_name, s.name)) LIKE '%qa%'""")
def name_search(t):
    board = Q.debater_board(G.debater_totals(scored(t), t.pairs), team_standings(t), t.people, t.schools, diagnostics(t))
    return Q.name_search(board, "Qa", ["name"], "school").select("season_id", "debater_id", "rank")


@query("page_slice", """
SELECT season_id, debater_id, CAST(rn AS INTEGER) AS row_no, CAST(ceil(n / 50.0) AS INTEGER) AS total_pages, CAST(least(2, ceil(n / 50.0)) AS INTEGER) AS current FROM (
  SELECT season_id, debater_id, row_number() OVER (PARTITION BY season_id ORDER BY points DESC, debater_id) AS rn, count(*) OVER (PARTITION BY season_id) AS n FROM debater_totals) AS x
WHERE rn BETWEEN (least(2, ceil(n / 50.0)) - 1) * 50 + 1 AND least(2, ceil(n / 50.0)) * 50""")
def page_slice(t):
    d = G.debater_totals(scored(t), t.pairs)
    return Q.page_slice(d, 2, "points", [F.asc("debater_id")], ["season_id"]).select("season_id", "debater_id", "row_no", "total_pages", "current")


@query("profile_rounds", """
SELECT q.event_id, q.round_id, q.entry_id, q.side, CAST(q.n AS INTEGER) AS ballots, CAST(q.w AS INTEGER) AS ballots_won, q.bye, q.opp AS opponent, CAST(p.m AS INTEGER) AS round_panel FROM (
  SELECT event_id, round_id, entry_id, max(side) AS side, sum(n) AS n, sum(w) AS w, bool_or(bye) AS bye, max(CASE WHEN entry_id = lo THEN nullif(hi, lo) ELSE lo END) AS opp FROM (
    SELECT b.event_id, b.round_id, b.section_id, b.entry_id, max(b.side) AS side, count(*) AS n, count(*) FILTER (WHERE won) AS w, bool_or(is_bye) AS bye, any_value(z.lo) AS lo, any_value(z.hi) AS hi
    FROM ballots AS b JOIN (SELECT section_id, min(entry_id) AS lo, max(entry_id) AS hi FROM ballots GROUP BY ALL) AS z ON z.section_id = b.section_id GROUP BY b.event_id, b.round_id, b.section_id, b.entry_id) AS s
  GROUP BY event_id, round_id, entry_id) AS q
JOIN (SELECT round_id, max(n) AS m FROM (SELECT round_id, section_id, entry_id, count(*) AS n FROM ballots GROUP BY ALL) AS r GROUP BY ALL) AS p ON p.round_id = q.round_id""")
def profile_rounds(t):
    e = t.entries.select("entry_id", "school_id", F.lit(None).cast("string").alias("elim_level"))
    r = t.rounds.select("event_id", "round_id", "name", "kind", F.lit(None).cast("string").alias("elim_level"))
    cat = t.events.select("event_id", F.lit("Regular").alias("category"))
    return Q.profile_rounds(t.ballots, r, e, cat).select("event_id", "round_id", "entry_id", "side", "ballots", "ballots_won", "bye", "opponent", "round_panel")


@query("profile_tournaments", """
SELECT r.season_id, v.debater_id AS person_id, r.tournament_id, r.entry_id, r.points, coalesce(w.weight, 0) AS weight, CASE WHEN r.two THEN CASE WHEN v.debater_id = r.d1 THEN r.d2 ELSE r.d1 END END AS partner_id
FROM results AS r JOIN who AS v ON v.supp = r.supp LEFT JOIN (SELECT a.*, w.weight FROM (SELECT v.debater_id, r.entry_id, row_number() OVER (PARTITION BY r.season_id, v.debater_id ORDER BY r.points DESC, r.entry_id) AS rn
  FROM results AS r JOIN who AS v ON v.supp = r.supp WHERE r.excluded_reason IS NULL) AS a JOIN weights AS w ON w.place = a.rn) AS w ON w.debater_id = v.debater_id AND w.entry_id = r.entry_id""")
def profile_tournaments(t):
    res = entry_results(t)
    e = res.select("entry_id", "tournament_id", "school_id", F.col("wins").alias("prelim_wins"), F.col("losses").alias("prelim_losses"),
                   F.lit(None).cast("string").alias("elim_level"), F.lit(False).alias("won_final"))
    out = Q.profile_tournaments(t.links, t.canon, t.people, e, res.select("entry_id", "points", "excluded_reason"), t.tournaments, t.schools)
    return out.select("season_id", "person_id", "tournament_id", "entry_id", "points", "weight", "partner_id")


@query("profile_identity", """
SELECT d.season_id, d.debater_id, p.shown AS name, d.points, d.rank, d.auto_qualified, CAST(s.ballots AS INTEGER) AS ballots FROM (SELECT coalesce(a.season_id, b.season_id) AS season_id, coalesce(a.debater_id, b.person_id) AS debater_id, a.points, a.rank, coalesce(a.auto_qualified, FALSE) AS auto_qualified
  FROM debater_totals AS a FULL OUTER JOIN speakers AS b ON b.season_id = a.season_id AND b.person_id = a.debater_id) AS d JOIN people AS p ON p.debater_id = d.debater_id AND p.shown IS NOT NULL
LEFT JOIN speakers AS s ON s.season_id = d.season_id AND s.person_id = d.debater_id""")
def profile_identity(t):
    return Q.profile_identity(t.people, t.schools, G.debater_totals(scored(t), t.pairs), speakers(t)).select(
        "season_id", "debater_id", "name", "points", "rank", "auto_qualified", "ballots")


@query("opponent_names", """
SELECT e.entry_id, coalesce(s.short_name, s.name) AS school, e.school_id, coalesce((SELECT string_agg(p.shown, ' & ' ORDER BY p.last, p.debater_id) FROM people AS p WHERE p.debater_id IN (e.d1, CASE WHEN e.two THEN e.d2 END)), '') AS names,
  CAST((SELECT count(*) FROM people AS p WHERE p.debater_id IN (e.d1, CASE WHEN e.two THEN e.d2 END) AND p.shown IS NULL) AS INTEGER) AS withheld FROM entries AS e LEFT JOIN schools AS s ON s.school_id = e.school_id""")
def opponent_names(t):
    return Q.opponent_names(t.entries, t.links, t.canon, t.people, t.schools)


@query("resolve_person", """
SELECT p.debater_id, CASE WHEN NOT bool_or(p.suppressed) OVER (PARTITION BY CASE WHEN i % 7 = 3 THEN 'd' || CAST(i - 3 AS VARCHAR) ELSE p.debater_id END) THEN
  CASE WHEN i % 7 = 3 THEN 'd' || CAST(i - 3 AS VARCHAR) ELSE p.debater_id END END AS person_id FROM (SELECT *, CAST(replace(debater_id, 'd', '') AS INTEGER) AS i FROM people) AS p""")
def resolve_person(t):
    i = F.regexp_replace("debater_id", "d", "").cast("int")
    other = F.when(i % 7 == 3, F.concat(F.lit("d"), (i - 3).cast("string")))
    return Q.resolve_person(t.people.withColumn("canonical_id", other))


@query("seasons", """
SELECT season_id, CAST(count(DISTINCT tournament_id) AS INTEGER) AS tournaments, max(ends_on) AS last_result_on FROM tournaments GROUP BY ALL""")
def seasons(t):
    return Q.seasons(t.tournaments.select("season_id").distinct(), t.tournaments)


@query("latest_rated_season", "SELECT max(season_id) AS season_id FROM figs")
def latest_rated_season(t):
    return Q.latest_rated_season(ratings(t))


@query("freshness", """
SELECT user_id, round((epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(max(ts))) / 3600000000.0::DOUBLE, 6) AS age_hours, (epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(max(ts))) / 3600000000.0::DOUBLE > 36 AS stale FROM events GROUP BY user_id""")
def freshness(t):
    runs_ = t.raw("events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("finished_at"))
    return Q.freshness(runs_, F.lit("2024-03-01 00:00:00").cast("timestamp")).select("user_id", F.round("age_hours", 6).alias("age_hours"), "stale")


@query("sender_rate", """
SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS INTEGER) AS last_hour,
  CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING) AS INTEGER) AS last_day FROM events""")
def sender_rate(t):
    e = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return Q.sender_rate(e, "user_id", "ts", {"last_hour": 3600, "last_day": 86400}).select("event_id", "last_hour", "last_day")


@query("sender_decisions")
def sender_decisions(t):
    e = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return Q.sender_decisions(e, "user_id", "ts", "event_id")


@query("sender_windows", """
SELECT user_id, starts_at, starts_at + INTERVAL 1 HOUR AS ends_at, CAST(count(*) AS INTEGER) AS n FROM (
  SELECT user_id, time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * k AS starts_at FROM events, (VALUES (0), (1), (2), (3), (4), (5)) AS v(k)) AS x GROUP BY ALL""")
def sender_windows(t):
    from verdikt.streaming.sender_stream import sender_windows as windows
    return windows(t.raw("events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")
