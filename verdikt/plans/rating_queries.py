"""Queries over sections, rating periods, ratings and their validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from verdikt.operators import bradley_terry as BT, glicko as GL, sections as X, validation as V
from verdikt.operators.lineage import cut_lineage
from verdikt.plans.driver_tables import DriverTables, loaded_as
from verdikt.plans.registry import query


def sides(t: DriverTables) -> DataFrame:
    return X.section_sides(t.side_counts)


def classified(t: DriverTables) -> DataFrame:
    def build() -> DataFrame:
        s = sides(t)
        return X.classify_sections(s, X.resolve_partnerships(s, t.people, t.members))
    return loaded_as(t, "classified", build)


def periods(t: DriverTables) -> DataFrame:
    return loaded_as(t, "periods", lambda: X.rating_periods(classified(t)))


def rated(t: DriverTables) -> DataFrame:
    return loaded_as(t, "rated", lambda: X.place_in_periods(X.rated_rounds(classified(t)), periods(t)))


def contested(t: DriverTables) -> DataFrame:
    return loaded_as(t, "contested", lambda: X.place_in_periods(X.contested_rounds(classified(t)), periods(t)))


def members(t: DriverTables) -> DataFrame:
    everyone = (rated(t).select("season_id", F.explode(F.array("a", "b")).alias("subject"))
                .union(contested(t).select("season_id", "subject")).distinct())
    return everyone.select("season_id", "subject", F.explode(F.split("subject", r"\|")).alias("debater_id"))


def season_run(t: DriverTables) -> GL.Run:
    """One run of every season, kept with its history and with what its predictions need."""
    def build() -> DataFrame:
        run = GL.run_season(rated(t), contested(t), members(t))
        for name in ("history", "entering", "spreads"):
            loaded_as(t, name, lambda: getattr(run, name))  # noqa: B023
        return run.state
    state = loaded_as(t, "state", build)
    history, entering, spreads = (loaded_as(t, name, None) for name in ("history", "entering", "spreads"))
    return GL.Run(state, history, None, ["season_id"], entering, spreads)


def told(t: DriverTables) -> DataFrame:
    """Every round with the word of the season's run on it."""
    return loaded_as(t, "predictions", lambda: GL.predict_rounds(rated(t), season_run(t)))


@query("section_sides", "SELECT season_id, tournament_id, event_id, kind, section_id, entry_id, side, is_bye, decided, won FROM sides")
def section_sides(t):
    return sides(t).select("season_id", "tournament_id", "event_id", "kind", "section_id", "entry_id", "side", "is_bye", "decided", "won")


@query("section_classes", "SELECT season_id, reason, CAST(count(*) AS INTEGER) AS sections FROM classified GROUP BY ALL")
def section_classes(t):
    return X.skip_counts(classified(t))


@query("rated_rounds", """
SELECT season_id, tournament_id, section_id, kind, a, b, won_a, ballots, side_a, period_seq FROM rated""")
def rated_rounds(t):
    return rated(t).select("season_id", "tournament_id", "section_id", "kind", "a", "b", "won_a", "ballots", "side_a", "period_seq")


@query("contested", """
SELECT season_id, tournament_id, kind, subject, CAST(count(*) AS INTEGER) AS contested FROM (
  SELECT season_id, tournament_id, kind, a AS subject FROM classified WHERE reason IN ('undecided', 'tied', 'unknown_team')
  UNION ALL SELECT season_id, tournament_id, kind, b FROM classified WHERE reason IN ('undecided', 'tied', 'unknown_team')) AS x
WHERE subject IS NOT NULL GROUP BY ALL""")
def contested_rounds(t):
    return contested(t).select("season_id", "tournament_id", "kind", "subject", "contested")


@query("rating_periods", "SELECT season_id, tournament_id, phase, starts_on AS date, rounds, period_seq, final FROM periods")
def rating_periods(t):
    return periods(t).select("season_id", "tournament_id", "phase", "date", "rounds", "period_seq", "final")


@query("side_advantage", """
SELECT season_id, won_first, decided_rounds, CASE WHEN won_first = 0 OR won_first = decided_rounds THEN 0
  ELSE round(173.7178::DOUBLE * ln((won_first::DOUBLE / decided_rounds) / (1 - won_first::DOUBLE / decided_rounds)), 6) END AS side_advantage
FROM (SELECT season_id, count(*) FILTER (WHERE 2 * won_a <> ballots AND CASE WHEN side_a = 1 THEN 2 * won_a > ballots ELSE 2 * won_a < ballots END) AS won_first,
  count(*) FILTER (WHERE 2 * won_a <> ballots) AS decided_rounds FROM rated GROUP BY ALL) AS x""")
def side_advantage(t):
    return X.side_advantage(rated(t), ["season_id"]).withColumn("side_advantage", F.round("side_advantage", 6))


@query("ballot_scores", """
SELECT won_a, ballots, round(CASE WHEN 2 * won_a > ballots THEN 1.0::DOUBLE WHEN 2 * won_a < ballots THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END, 6) AS decisive,
  round(won_a::DOUBLE / ballots, 6) AS graded, count(*) AS rounds FROM rated GROUP BY won_a, ballots""")
def ballot_scores(t):
    r = rated(t).select("won_a", "ballots", F.round(GL.ballot_score("won_a", "ballots", 0.0), 6).alias("decisive"),
                        F.round(GL.ballot_score("won_a", "ballots", 1.0), 6).alias("graded"))
    return r.groupBy("won_a", "ballots", "decisive", "graded").agg(F.count("*").alias("rounds"))


_FIGURES = """(SELECT season_id, subject, 1500 + 20.0::DOUBLE * (2 * w - n) AS rating, greatest(60.0::DOUBLE, 350.0::DOUBLE / sqrt(n)) AS deviation, n AS rounds FROM (
  SELECT season_id, subject, count(*) AS n, sum(w) AS w FROM (
    SELECT season_id, a AS subject, CASE WHEN 2 * won_a > ballots THEN 1 ELSE 0 END AS w FROM rated
    UNION ALL SELECT season_id, b, CASE WHEN 2 * won_a > ballots THEN 0 ELSE 1 END FROM rated) AS x GROUP BY ALL) AS y)"""


def figures(t: DriverTables) -> DataFrame:
    """A closed-form stand-in for a rating, so that what reads ratings can be checked in SQL."""
    both = V._both_sides(rated(t).select("*")).groupBy("season_id", "subject").agg(
        F.count("*").alias("rounds"), F.sum("w").alias("w"))
    return both.select("season_id", "subject", (1500 + 20.0 * (2 * F.col("w") - F.col("rounds"))).alias("rating"),
                       F.greatest(F.lit(60.0), 350.0 / F.sqrt("rounds")).alias("deviation"), "rounds")


@query("decay_curve", f"""
SELECT season_id, subject, weeks, round(least(350.0::DOUBLE, sqrt(power(deviation / 173.7178::DOUBLE, 2) + 0.06::DOUBLE * 0.06::DOUBLE * weeks) * 173.7178::DOUBLE), 6) AS deviation
FROM {_FIGURES} AS f, (VALUES (1), (4), (26), (52)) AS v(weeks)""")
def decay_curve(t):
    weeks = F.explode(F.array(*map(F.lit, (1, 4, 26, 52)))).alias("weeks")
    return figures(t).select("*", weeks).select("season_id", "subject", "weeks", F.round(
        GL.decayed(F.col("deviation"), F.lit(0.06), F.col("weeks").cast("double")), 6).alias("deviation"))


_PREDICTED = f"""(SELECT r.*, 1 / (1 + exp(-(1 / sqrt(1 + 3 * power(sqrt(x.deviation * x.deviation + y.deviation * y.deviation) / 173.7178::DOUBLE, 2) / power(pi(), 2)))
    * (x.rating + CASE WHEN side_a = 1 THEN 12.5::DOUBLE ELSE -12.5::DOUBLE END - y.rating) / 173.7178::DOUBLE)) AS p_a
  FROM rated AS r JOIN {_FIGURES} AS x ON x.season_id = r.season_id AND x.subject = r.a
  JOIN {_FIGURES} AS y ON y.season_id = r.season_id AND y.subject = r.b)"""
_P = "(SELECT *, CASE WHEN 2 * won_a > ballots THEN p_a ELSE 1 - p_a END AS p FROM " + _PREDICTED + " AS w)"


def predicted(t: DriverTables) -> DataFrame:
    f = figures(t)
    out = rated(t)
    for s in "ab":
        out = out.join(f.select("season_id", F.col("subject").alias(s), F.col("rating").alias(f"r_{s}"),
                                F.col("deviation").alias(f"d_{s}")), ["season_id", s])
    adv = F.when(F.col("side_a") == 1, 12.5).otherwise(-12.5)
    return out.withColumn("p_a", GL.win_probability(F.col("r_a"), F.col("d_a"), F.col("r_b"), F.col("d_b"), adv)).withColumn(
        "p", V.outcome_probability())


@query("win_probability", f"SELECT season_id, section_id, round(p_a, 6) AS p_a FROM {_PREDICTED} AS q")
def win_probability(t):
    return predicted(t).select("season_id", "section_id", F.round("p_a", 6).alias("p_a"))


@query("prediction_metrics", f"""
SELECT season_id, kind, CAST(count(*) AS INTEGER) AS n, round(avg(CASE WHEN p > 0.5 THEN 1.0::DOUBLE WHEN p = 0.5 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy,
  round(avg(-ln(greatest(p, 1e-12))), 6) AS log_loss, round(avg((1 - p) * (1 - p)), 6) AS brier FROM {_P} AS q GROUP BY ALL""")
def prediction_metrics(t):
    return _rounded(V.prediction_metrics(predicted(t), ["season_id", "kind"]))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    names = names or tuple(f.name for f in df.schema if f.dataType.typeName() == "double")
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("calibration", f"""
SELECT season_id, bucket, CAST(count(*) AS INTEGER) AS n, round(avg(c), 6) AS said, round(avg(CASE WHEN p > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS actual
FROM (SELECT *, CASE WHEN c < 0.55 THEN 0 WHEN c < 0.6 THEN 1 WHEN c < 0.65 THEN 2 WHEN c < 0.7 THEN 3 WHEN c < 0.8 THEN 4 WHEN c < 0.9 THEN 5 ELSE 6 END AS bucket
  FROM (SELECT *, greatest(p, 1 - p) AS c FROM {_P} AS q) AS z) AS y GROUP BY season_id, bucket""")
def calibration(t):
    return _rounded(V.calibration(predicted(t), ["season_id"]))


@query("implied_ceiling", f"SELECT season_id, round(avg(greatest(p, 1 - p)), 6) AS implied FROM {_P} AS q GROUP BY season_id")
def implied_ceiling(t):
    return _rounded(V.implied_ceiling(predicted(t), ["season_id"]))


@query("field_spread_shrink", f"""
SELECT f.season_id, f.subject, round(s.tau, 6) AS tau, round(1500 + (f.rating - 1500) * (s.tau * s.tau) / (s.tau * s.tau + f.deviation * f.deviation), 6) AS shrunk
FROM {_FIGURES} AS f JOIN (SELECT season_id, CASE WHEN count(*) < 2 THEN 350 ELSE sqrt(greatest(var_pop(rating) - avg(deviation * deviation), var_pop(rating) * 0.05::DOUBLE)) END AS tau
  FROM {_FIGURES} AS g WHERE rounds >= 5 GROUP BY season_id) AS s ON s.season_id = f.season_id""")
def field_spread_shrink(t):
    f = figures(t)
    tau = GL.field_spread(f.where("rounds >= 5"), ["season_id"])
    return _rounded(f.join(tau, "season_id").select("season_id", "subject", "tau", GL.shrink_to_field(
        F.col("rating"), F.col("deviation"), F.col("tau")).alias("shrunk")))


@query("period_evidence", f"""
SELECT season_id, subject, round(sum(g * g * e * (1 - e)), 6) AS v_inv, round(sum(g * (score - e)), 6) AS delta_sum, count(*) AS rounds FROM (
SELECT *, 1 / (1 + exp(-g * (mine - theirs) / 173.7178::DOUBLE)) AS e FROM (
SELECT z.season_id, z.subject, 1 / sqrt(1 + 3 * power(y.deviation / 173.7178::DOUBLE, 2) / power(pi(), 2)) AS g, x.rating AS mine, y.rating AS theirs, z.score
FROM (SELECT season_id, a AS subject, b AS other, won_a::DOUBLE / ballots AS score FROM rated
      UNION ALL SELECT season_id, b, a, 1 - won_a::DOUBLE / ballots FROM rated) AS z
JOIN {_FIGURES} AS x ON x.season_id = z.season_id AND x.subject = z.subject
JOIN {_FIGURES} AS y ON y.season_id = z.season_id AND y.subject = z.other) AS q) AS w GROUP BY ALL""")
def period_evidence(t):
    f = figures(t)
    s = F.explode(F.array(
        F.struct(F.col("a").alias("subject"), F.col("b").alias("other"), GL.ballot_score("won_a", "ballots", 1.0).alias("score")),
        F.struct(F.col("b").alias("subject"), F.col("a").alias("other"), (1 - GL.ballot_score("won_a", "ballots", 1.0)).alias("score")))).alias("s")
    faced = (rated(t).select("season_id", s).select("season_id", "s.*")
             .join(f.select("season_id", "subject", "rating"), ["season_id", "subject"])
             .join(f.select("season_id", F.col("subject").alias("other"), F.col("rating").alias("their_rating"),
                            F.col("deviation").alias("their_deviation")), ["season_id", "other"]))
    return GL.evidence(faced.withColumn("advantage", F.lit(0.0))).groupBy("season_id", "subject").agg(
        F.round(F.sum("info"), 6).alias("v_inv"), F.round(F.sum("pull"), 6).alias("delta_sum"), F.count("*").alias("rounds"))


@query("season_ratings")
def season_ratings(t):
    return GL.standings_at(season_run(t).state, ["season_id"])


@query("rating_rows")
def rating_rows(t):
    return GL.rating_rows(season_run(t))


@query("debater_estimates")
def debater_estimates(t):
    run = season_run(t)
    dates = run.state.groupBy("season_id").agg(F.max("as_of").alias("prev_date"))
    return GL.debater_estimates(run.state, members(t).join(dates, "season_id"), ["season_id"])


@query("held_out_report")
def held_out_report(t):
    preds = V.prior_evidence(told(t)).withColumn("p", V.outcome_probability())
    return V.held_out_report(preds, ["season_id"])


@query("shrunk_predictions")
def shrunk_predictions(t):
    return V.prediction_metrics(shrunk(t).withColumn("p", V.outcome_probability()), ["season_id"])


@query("iterated_ratings")
def iterated_ratings(t):
    return GL.standings_at(GL.run_season_iterated(rated(t), contested(t), members(t)).state, ["season_id"])


@query("option_sweep")
def option_sweep(t):
    """Side advantage from each season's first eight periods, metrics on the rest."""
    r = rated(t)
    side = X.side_advantage(r.where("period_seq <= 8"), ["season_id"]).select("season_id", F.col("side_advantage").alias("side_points"))
    r = cut_lineage(r.join(side, "season_id", "left").fillna(0.0, ["side_points"]))
    return V.sweep_grid(r, contested(t), members(t), F.col("side_points"), F.col("period_seq") > 8)


@query("elo_sweep")
def elo_sweep(t):
    return V.sweep_elo(rated(t), F.col("period_seq") <= 8, F.col("period_seq") > 8)


def bt_season_fit(t: DriverTables) -> tuple[DataFrame, DataFrame]:
    def build() -> DataFrame:
        strengths, fits = BT.fit_bradley_terry(BT.bt_rounds(rated(t)), ["season_id"], 1.5)
        loaded_as(t, "bt_season_fits", lambda: fits)
        return strengths
    strengths = loaded_as(t, "bt_season_strengths", build)
    return strengths, loaded_as(t, "bt_season_fits", None)


@query("bt_fit")
def bt_fit(t):
    strengths, fits = bt_season_fit(t)
    return strengths.join(fits, "season_id").withColumn("rating", BT.bt_to_rating("strength"))


@query("bt_optimality", """
SELECT DISTINCT season_id, subject, 0.0::DOUBLE AS slope FROM (SELECT season_id, a AS subject FROM rated UNION ALL SELECT season_id, b FROM rated) AS x""")
def bt_optimality(t):
    """At the optimum what the rounds pull and what the penalty holds cancel out for every subject."""
    rounds = BT.bt_rounds(rated(t))
    strengths, fits = bt_season_fit(t)
    odds = BT.bt_log_odds(rounds, strengths, fits, ["season_id"]).withColumn("g", 1 / (1 + F.exp(-F.col("log_odds"))) - F.col("score"))
    side = lambda ids, sign: odds.select("season_id", F.explode(ids).alias("subject"), (sign * F.col("g")).alias("pull"))
    pulls = side("side_a_ids", 1.0).union(side("side_b_ids", -1.0)).groupBy("season_id", "subject").agg(F.sum("pull").alias("pull"))
    return pulls.join(strengths, ["season_id", "subject"]).select("season_id", "subject", F.abs(F.round(F.col("pull") + 1.5 * F.col("strength"), 3)).alias("slope"))


@query("bt_people_sweep")
def bt_people_sweep(t):
    return V.sweep_bt(rated(t), F.col("period_seq") <= 10, F.col("period_seq") > 10, "people")


@query("bt_walk_forward")
def bt_walk_forward(t):
    """Metrics by season of every round after its first period, each by strengths fitted on the periods before."""
    return V.prediction_metrics(walked(t, "pairs").withColumn("p", V.outcome_probability()), ["season_id"])


@query("elo", """
WITH RECURSIVE games AS (SELECT season_id, period_seq, section_id, a, b, CASE WHEN 2 * won_a > ballots THEN 1.0::DOUBLE WHEN 2 * won_a < ballots THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS score,
    row_number() OVER (PARTITION BY season_id ORDER BY period_seq, section_id) AS i FROM rated),
  run AS (SELECT DISTINCT season_id, CAST(0 AS BIGINT) AS i, CAST(MAP {} AS MAP(VARCHAR, DOUBLE)) AS known, 0.0::DOUBLE AS ra, 0.0::DOUBLE AS rb, 0.0::DOUBLE AS gain FROM games
    UNION ALL SELECT season_id, i, map_concat(known, MAP([a, b], [ra + gain, rb - gain])), ra, rb, gain FROM (
      SELECT *, 48 * (score - 1 / (1 + power(10.0::DOUBLE, (rb - ra) / 400))) AS gain FROM (
        SELECT g.season_id, g.i, r.known, g.a, g.b, g.score, coalesce(r.known[g.a], 1500.0::DOUBLE) AS ra, coalesce(r.known[g.b], 1500.0::DOUBLE) AS rb
        FROM run AS r JOIN games AS g ON g.season_id = r.season_id AND g.i = r.i + 1) AS x) AS y)
SELECT g.season_id, g.period_seq, g.section_id, g.a, g.b, round(r.ra, 6) AS ra, round(r.rb, 6) AS rb, round(r.gain, 6) AS gain FROM games AS g JOIN run AS r ON r.season_id = g.season_id AND r.i = g.i""")
def elo(t):
    """Carried through each season."""
    return _rounded(V.elo(rated(t), 48.0).select("season_id", "period_seq", "section_id", "a", "b", "ra", "rb", "gain"))


_RECORD = """(SELECT season_id, subject, period_seq, coalesce(sum(n) OVER w, 0) AS nb, coalesce(sum(w1) OVER w, 0) AS wb FROM (
    SELECT season_id, subject, period_seq, count(*) AS n, sum(win) AS w1 FROM (
      SELECT season_id, a AS subject, period_seq, CASE WHEN 2 * won_a > ballots THEN 1 ELSE 0 END AS win FROM rated
      UNION ALL SELECT season_id, b, period_seq, CASE WHEN 2 * won_a > ballots THEN 0 ELSE 1 END FROM rated) AS s GROUP BY ALL) AS z
  WINDOW w AS (PARTITION BY season_id, subject ORDER BY period_seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("win_rate_to_date", f"""
SELECT r.season_id, r.section_id, round((x.wb + 2.0::DOUBLE) / (x.nb + 4) - (y.wb + 2.0::DOUBLE) / (y.nb + 4), 6) AS rate_gap
FROM rated AS r JOIN {_RECORD} AS x ON x.season_id = r.season_id AND x.subject = r.a AND x.period_seq = r.period_seq
JOIN {_RECORD} AS y ON y.season_id = r.season_id AND y.subject = r.b AND y.period_seq = r.period_seq""")
def win_rate_to_date(t):
    return _rounded(V.win_rate_to_date(rated(t)).select("season_id", "section_id", "rate_gap"))


@query("prior_evidence", f"""
SELECT r.season_id, r.section_id, CAST(least(x.nb, y.nb) AS INTEGER) AS min_rounds
FROM rated AS r JOIN {_RECORD} AS x ON x.season_id = r.season_id AND x.subject = r.a AND x.period_seq = r.period_seq
JOIN {_RECORD} AS y ON y.season_id = r.season_id AND y.subject = r.b AND y.period_seq = r.period_seq""")
def prior_evidence(t):
    return V.prior_evidence(rated(t)).select("season_id", "section_id", "min_rounds")


def earned(t: DriverTables) -> DataFrame:
    from verdikt.plans.scoring_queries import entry_results
    return (entry_results(t).where("excluded_reason is null").join(t.pairs.select("entry_id", "pair"), "entry_id")
            .where("division = 'open'").select("season_id", "tournament_id", F.col("pair").alias("subject"), F.col("points").cast("double").alias("points")))


@query("points_to_date", f"""
SELECT r.season_id, r.section_id, round((coalesce(x.total, 0) - coalesce(y.total, 0)) / 10, 6) AS points_gap
FROM rated AS r LEFT JOIN gain_totals AS x ON x.season_id = r.season_id AND x.subject = r.a AND x.period_seq = r.period_seq
LEFT JOIN gain_totals AS y ON y.season_id = r.season_id AND y.subject = r.b AND y.period_seq = r.period_seq""")
def points_to_date(t):
    return _rounded(V.points_to_date(rated(t), earned(t), periods(t)).select("season_id", "section_id", "points_gap"))


@query("predict_tournaments", f"""
SELECT q.season_id, q.section_id, round(p, 6) AS p, round(greatest(p_a, 1 - p_a), 6) AS favourite,
  CASE WHEN g.gap = 0 THEN 0.5 WHEN (g.gap > 0) = (2 * won_a > ballots) THEN 1.0 ELSE 0.0 END AS points_call
FROM {_P} AS q JOIN (SELECT r.season_id, r.section_id, round((coalesce(x.total, 0) - coalesce(y.total, 0)) / 10, 6) AS gap
  FROM rated AS r LEFT JOIN gain_totals AS x ON x.season_id = r.season_id AND x.subject = r.a AND x.period_seq = r.period_seq
  LEFT JOIN gain_totals AS y ON y.season_id = r.season_id AND y.subject = r.b AND y.period_seq = r.period_seq) AS g ON g.section_id = q.section_id
WHERE q.tournament_id LIKE '%-10-01'""")
def predict_tournaments(t):
    points = V.points_to_date(rated(t), earned(t), periods(t))
    out = V.predict_tournaments(predicted(t), points.withColumn("points_gap", F.round("points_gap", 6)),
                                F.col("tournament_id").like("%-10-01"))
    return _rounded(out.select("season_id", "section_id", "p", "favourite", "points_call"))


@query("side_only", """
SELECT season_id, CAST(count(*) AS INTEGER) AS n, round(avg(CASE WHEN p > 0.5 THEN 1.0 WHEN p = 0.5 THEN 0.5 ELSE 0.0 END), 6) AS accuracy, round(avg(-ln(p)), 6) AS log_loss, round(avg((1 - p) * (1 - p)), 6) AS brier FROM (
  SELECT r.season_id, round(CASE WHEN 2 * won_a > ballots THEN q.share ELSE 1 - q.share END, 9) AS p FROM rated AS r
  JOIN (SELECT season_id, side_a = 1 AS first, avg(CASE WHEN 2 * won_a > ballots THEN 1.0 ELSE 0.0 END)::DOUBLE AS share FROM rated WHERE period_seq <= 8 GROUP BY ALL) AS q
    ON q.first = (r.side_a = 1) AND q.season_id = r.season_id
  WHERE r.period_seq > 8) AS x GROUP BY season_id""")
def side_only(t):
    """Fitted on each season's first eight periods, scored on its rest. With one two-valued feature the fit is the share won."""
    r = rated(t)
    preds = V.side_only(r.where("period_seq <= 8"), r.where("period_seq > 8")).withColumn("p", F.round(V.outcome_probability(), 9))
    return _rounded(V.prediction_metrics(preds, ["season_id"]))


def _newton_sql(feature: str, source: str, steps: int = 12) -> str:
    """Metrics by season of a logistic fit of ``feature`` and the side on the first eight periods, its Newton steps written out."""
    sql = f"""WITH raw AS ({source}), f AS (SELECT r.season_id, r.period_seq, raw.{feature} AS x, CASE WHEN r.side_a = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s,
      CASE WHEN 2 * r.won_a > r.ballots THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM rated AS r JOIN raw ON raw.season_id = r.season_id AND raw.section_id = r.section_id),
  beta0 AS (SELECT season_id, count(*) >= 30 AS enough, 0.0::DOUBLE AS c, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v FROM f WHERE period_seq <= 8 GROUP BY season_id)"""
    for k in range(steps):
        sql += f""",
  sums{k} AS (SELECT season_id, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum((y - p) * s) AS g2, sum(w) + 1e-6 AS a, sum(w * x) AS b, sum(w * s) AS d, sum(w * x * x) + 1e-6 AS e, sum(w * x * s) AS h, sum(w) + 1e-6 AS i
    FROM (SELECT *, greatest(1e-9, p * (1 - p)) AS w FROM (SELECT f.*, 1 / (1 + exp(-(b.c + b.u * f.x + b.v * f.s))) AS p FROM f JOIN beta{k} AS b ON b.season_id = f.season_id WHERE f.period_seq <= 8) AS q) AS z GROUP BY season_id),
  solved{k} AS (SELECT *, a * (e * i - h * h) - b * (b * i - h * d) + d * (b * h - e * d) AS det FROM sums{k}),
  beta{k + 1} AS (SELECT b.season_id, b.enough, CASE WHEN enough THEN b.c + (g0 * (e * i - h * h) - b_ * (g1 * i - h * g2) + d * (g1 * h - e * g2)) / det ELSE 0.0 END AS c,
    CASE WHEN enough THEN b.u + (a * (g1 * i - h * g2) - g0 * (b_ * i - h * d) + d * (b_ * g2 - g1 * d)) / det ELSE 0.0 END AS u,
    CASE WHEN enough THEN b.v + (a * (e * g2 - g1 * h) - b_ * (b_ * g2 - g1 * d) + g0 * (b_ * h - e * d)) / det ELSE 0.0 END AS v
    FROM beta{k} AS b JOIN (SELECT *, b AS b_ FROM solved{k}) AS t ON t.season_id = b.season_id)"""
    return sql + f"""
SELECT season_id, CAST(count(*) AS INTEGER) AS n, round(avg(CASE WHEN q > 0.5 THEN 1.0::DOUBLE WHEN q = 0.5 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy,
  round(avg(-ln(greatest(q, 1e-12))), 6) AS log_loss, round(avg((1 - q) * (1 - q)), 6) AS brier
FROM (SELECT f.season_id, round(CASE WHEN f.y = 1 THEN p ELSE 1 - p END, 9) AS q FROM (SELECT f.*, 1 / (1 + exp(-(coalesce(b.c, 0) + coalesce(b.u, 0) * f.x + coalesce(b.v, 0) * f.s))) AS p
  FROM f LEFT JOIN beta{steps} AS b ON b.season_id = f.season_id WHERE f.period_seq > 8) AS f) AS z GROUP BY season_id"""


def _fitted_metrics(rows: DataFrame, feature: str) -> DataFrame:
    preds = V.fitted(rows.withColumn("side", V.side_feature()), [feature, "side"], F.col("period_seq") <= 8)
    return _rounded(V.prediction_metrics(preds.withColumn("p", F.round(V.outcome_probability(), 9)), ["season_id"]))


@query("win_rate_model", _newton_sql("rate_gap", f"""SELECT r.season_id, r.section_id, (x.wb + 2.0::DOUBLE) / (x.nb + 4) - (y.wb + 2.0::DOUBLE) / (y.nb + 4) AS rate_gap
  FROM rated AS r JOIN {_RECORD} AS x ON x.season_id = r.season_id AND x.subject = r.a AND x.period_seq = r.period_seq
  JOIN {_RECORD} AS y ON y.season_id = r.season_id AND y.subject = r.b AND y.period_seq = r.period_seq"""))
def win_rate_model(t):
    """Fitted by season on its first eight periods, scored on its rest."""
    return _fitted_metrics(V.win_rate_to_date(rated(t)), "rate_gap")


@query("points_model", _newton_sql("points_gap", """SELECT r.season_id, r.section_id, (coalesce(x.total, 0) - coalesce(y.total, 0)) / 10 AS points_gap
  FROM rated AS r LEFT JOIN gain_totals AS x ON x.season_id = r.season_id AND x.subject = r.a AND x.period_seq = r.period_seq
  LEFT JOIN gain_totals AS y ON y.season_id = r.season_id AND y.subject = r.b AND y.period_seq = r.period_seq"""))
def points_model(t):
    """Fitted by season on its first eight periods, scored on its rest."""
    return _fitted_metrics(V.points_to_date(rated(t), earned(t), periods(t)), "points_gap")


@query("coin_flip", """
SELECT season_id, CAST(count(*) AS INTEGER) AS n, 0.5 AS accuracy, round(-ln(0.5), 6) AS log_loss, 0.25 AS brier FROM rated GROUP BY season_id""")
def coin_flip(t):
    return _rounded(V.prediction_metrics(V.coin_flip(rated(t)).withColumn("p", V.outcome_probability()), ["season_id"]))


def shrunk(t: DriverTables) -> DataFrame:
    """As ``told``, from the same run, with ratings pulled to the field."""
    return loaded_as(t, "shrunk", lambda: GL.predict_rounds(rated(t), season_run(t), shrink=True))


_WALKED = ("season_id", "section_id", "won_a", "ballots", "p_a")


def walked(t: DriverTables, unit: str) -> DataFrame:
    """Bradley-Terry over pairs, or over people, refit before each period."""
    return loaded_as(t, f"walked_{unit}", lambda: V.bt_models(rated(t), unit, 1.5, gradient=1e-6).select(*_WALKED))


def walked_both(t: DriverTables, unit: str) -> DataFrame:
    """As ``walked``; pairs and people descend together."""
    both = loaded_as(t, "walked_both", lambda: V.bt_models(rated(t), ("pairs", "people"), 1.5, gradient=1e-6).select("unit", *_WALKED))
    return both.where(F.col("unit") == unit).drop("unit")


#: Models by what they are made of; all are told on the same rounds.
FITTED = {"side": ["side"], "win rate": ["rate_gap", "side"], "points": ["points_gap", "side"], "elo": ["elo_gap", "side"]}
RATED = ("rating", "shrunk rating")
STRENGTHS = ("strengths of pairs", "strengths of people")


def held_out_rows(t: DriverTables, features: set[str]) -> DataFrame:
    """Every round with what was known before it, and those of ``features`` that are asked for."""
    on = ["season_id", "section_id"]
    rows = V.prior_evidence(rated(t)).select(*on, "period_seq", "a", "b", "won_a", "ballots", "side_a", "kind", "min_rounds").withColumn("side", V.side_feature())
    gaps = {"rate_gap": lambda: V.win_rate_to_date(rated(t)), "points_gap": lambda: V.points_to_date(rated(t), earned(t), periods(t)),
            "elo_gap": lambda: V.elo_before_period(V.elo(rated(t), 48.0), rated(t))}
    for name in sorted(features & set(gaps)):
        rows = rows.join(gaps[name]().select(*on, name), on)
    return cut_lineage(rows)


def held_out_models(t: DriverTables, names: tuple[str, ...]) -> DataFrame:
    """``season_id, model, section_id, kind, min_rounds, p``: the word of each model on every round after its season's eighth period.

    Whatever is fitted is fitted by season, on the periods before. All models feed one table, from which slices, calibration
    and paired draws come in one pass each.
    """
    train, on = F.col("period_seq") <= 8, ["season_id", "section_id"]
    rows = held_out_rows(t, {f for n in names for f in FITTED.get(n, [])})
    test = rows.where(~train)
    words = {"rating": lambda: told(t), "shrunk rating": lambda: shrunk(t), "strengths of pairs": lambda: walked_both(t, "pairs"),
            "strengths of people": lambda: walked_both(t, "people")}

    def predicted_by(name: str) -> DataFrame:
        if name == "coin flip":
            return V.coin_flip(test)
        return V.fitted(rows, FITTED[name], train) if name in FITTED else test.join(words[name]().select(*on, "p_a"), on)

    one = lambda name: predicted_by(name).select("season_id", F.lit(name).alias("model"), "section_id", "kind", "min_rounds", V.outcome_probability().alias("p"))
    return cut_lineage(reduce(DataFrame.unionByName, map(one, names)))


@query("held_out_table")
def held_out_table(t):
    """Seven models on the same rounds of each season: all, both sides known, either new, eliminations."""
    return _rounded(V.held_out_report(held_out_models(t, ("coin flip", *FITTED, *RATED)), ["season_id", "model"]))


@query("held_out_strengths")
def held_out_strengths(t):
    """The two Bradley-Terry models, as ``held_out_table``."""
    return _rounded(V.held_out_report(held_out_models(t, STRENGTHS), ["season_id", "model"]))


@query("held_out_calibration")
def held_out_calibration(t):
    return _rounded(V.calibration(held_out_models(t, RATED), ["season_id", "model"]))


@query("paired_bootstrap")
def paired_bootstrap(t):
    """The rating against points by season, over the rounds both predict: the verdict on accuracy and on log loss."""
    models = held_out_models(t, ("rating", "points"))
    pair = lambda name, out: models.where(F.col("model") == name).select("season_id", "section_id", F.col("p").alias(out))
    pairs = cut_lineage(pair("rating", "p_one").join(pair("points", "p_two"), ["season_id", "section_id"]))
    found = [V.paired_bootstrap(pairs, metric).withColumn("metric", F.lit(metric)) for metric in ("accuracy", "log_loss")]
    return found[0].unionByName(found[1])
