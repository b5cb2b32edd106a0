"""Serving queries: boards, summaries and profiles, each for every season or person at once.

Bind a season or a person with ``where`` on the result; the filter reaches the scans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from verdikt.functions.labels import STAGE_ORDER, walkover_direction
from verdikt.functions.text import masked_name
from verdikt.operators.glicko import (MIN_CALIBRATION_ROUNDS, MIN_RATED_ROUNDS, SCALE, field_spread)
from verdikt.operators.ranking import competition_rank, first_of_each, sequence_number, weighted_breakdown
from verdikt.operators.reconcile import EPSILON

PAGE_SIZE = 50
STALE_HOURS = 36
PER_HOUR, PER_DAY = 3, 10
AGREES_WITHIN = 0.05
SETTLED_SHARE = 0.01


def _schools(schools: DataFrame, on: str = "school_id", name: str = "school") -> DataFrame:
    return schools.select(F.col("school_id").alias(on), F.coalesce("short_name", "name").alias(name), "region")


def _people(people: DataFrame, id_: str, name: str) -> DataFrame:
    return people.select(F.col("debater_id").alias(id_), masked_name("first", "last", "suppressed").alias(name))


def team_state(totals: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Each partnership with whether it agrees with its published total, and by how much not."""
    said = diagnostics.where(F.col("team_id").isNotNull()).groupBy("season_id", "team_id").agg(
        F.max_by(F.struct("delta", "official_points"), "team_key").alias("d"))
    gap = F.abs(F.coalesce("d.delta", F.lit(0.0)))
    state = F.when(F.col("d").isNull(), "pending").when(gap > AGREES_WITHIN, "differs").otherwise("agrees")
    return (totals.withColumn("team_id", F.concat_ws("_", F.lit("team"), "season_id", "pair"))
            .join(said, ["season_id", "team_id"], "left").withColumn("state", state).withColumn("gap", gap)
            .withColumn("official_points", F.col("d.official_points")).drop("d"))


def team_board(totals: DataFrame, people: DataFrame, schools: DataFrame, debaters: DataFrame,
               diagnostics: DataFrame) -> DataFrame:
    out = team_state(totals, diagnostics).join(_schools(schools), "school_id", "left")
    for i in ("1", "2"):
        line = debaters.select("season_id", F.col("debater_id").alias(f"debater{i}_id"),
                               F.col("auto_qualified").cast("int").alias(f"_q{i}"))
        out = (out.join(_people(people, f"debater{i}_id", f"debater{i}"), f"debater{i}_id")
               .join(line, ["season_id", f"debater{i}_id"], "left"))
    qualified = F.coalesce("_q1", F.lit(0)) + F.coalesce("_q2", F.lit(0))
    return out.select("season_id", "rank", "points", "school", "region", "debater1", "debater2", "debater1_id",
                      "debater2_id", F.col("tournaments_counted").alias("tournaments"),
                      qualified.alias("partners_qualified"),
                      F.when(qualified == 2, "AQ").when(qualified == 1, "AL").alias("mark"),
                      "official_points", F.col("state").alias("reconciliation"))


def _exposure(state: DataFrame, key: str, ids: Column) -> DataFrame:
    return (state.select("season_id", F.explode(ids).alias(key), "state", "gap").where(F.col(key).isNotNull())
            .groupBy("season_id", key)
            .agg(F.sum("gap").alias("exposure"), F.bool_or(F.col("state") == "differs").alias("any_differs"),
                 F.bool_or(F.col("state") == "pending").alias("any_pending")))


def _settled() -> Column:
    exposure = F.coalesce("exposure", F.lit(0.0))
    return (F.when(F.col("any_differs") & (exposure >= SETTLED_SHARE * F.col("points")), "differs")
            .when(F.col("any_pending"), "pending").otherwise("agrees"))


def debater_board(debaters: DataFrame, totals: DataFrame, people: DataFrame, schools: DataFrame,
                  diagnostics: DataFrame) -> DataFrame:
    exposure = _exposure(team_state(totals, diagnostics), "debater_id", F.array("debater1_id", "debater2_id"))
    named = people.select("debater_id", "school_id", masked_name("first", "last", "suppressed").alias("name"))
    return (debaters.join(named, "debater_id").join(_schools(schools), "school_id", "left")
            .join(exposure, ["season_id", "debater_id"], "left")
            .select("season_id", "debater_id", "rank", "points", "name", "school", "region", "auto_qualified",
                    _settled().alias("reconciliation"), F.coalesce("exposure", F.lit(0.0)).alias("exposure")))


def school_board(school_totals: DataFrame, totals: DataFrame, schools: DataFrame, diagnostics: DataFrame) -> DataFrame:
    exposure = _exposure(team_state(totals, diagnostics), "school_id", F.array("school_id"))
    return (school_totals.join(_schools(schools, name="name"), "school_id")
            .join(exposure, ["season_id", "school_id"], "left")
            .select("season_id", "school_id", "rank", "points", "name", "region",
                    _settled().alias("reconciliation"), F.coalesce("exposure", F.lit(0.0)).alias("exposure")))


def speaker_board(speakers: DataFrame, people: DataFrame, schools: DataFrame) -> DataFrame:
    named = people.select(F.col("debater_id").alias("person_id"), "school_id",
                          masked_name("first", "last", "suppressed").alias("name"))
    return (speakers.where(F.col("rank").isNotNull()).join(named, "person_id")
            .join(_schools(schools), "school_id", "left")
            .select("season_id", "person_id", "rank", "ballots", "mean_z", "mean_display", "margin_display",
                    "mean_raw", "sd_z", "name", "school", "region"))


def speaker_summary(speakers: DataFrame, scores: DataFrame, canon: DataFrame) -> DataFrame:
    """Counts per season and the mean number of judges behind a ranked figure.

    scores: season_id debater_id judge_id z excluded.
    """
    ranked = F.col("rank").isNotNull()
    totals = speakers.groupBy("season_id").agg(
        F.count_if(ranked).cast("int").alias("ranked"), F.count("*").cast("int").alias("total"),
        F.coalesce(F.sum(F.when(ranked, F.col("ballots"))), F.lit(0)).cast("int").alias("ranked_ballots"))
    counts = scores.groupBy("season_id").agg(F.count("z").cast("int").alias("scores"),
                                             F.count_if("excluded").cast("int").alias("excluded"))
    seen = (scores.where(F.col("z").isNotNull() & F.col("judge_id").isNotNull())
            .select("season_id", "debater_id", "judge_id").distinct().join(canon, "debater_id")
            .join(speakers.where(ranked).select("season_id", "person_id"), ["season_id", "person_id"], "left_semi"))
    judges = (seen.groupBy("season_id", "person_id").agg(F.count_distinct("judge_id").alias("j"))
              .groupBy("season_id").agg(F.round(F.avg("j")).cast("int").alias("avg_judges")))
    return (totals.join(counts, "season_id", "left").join(judges, "season_id", "left")
            .fillna(0, ["scores", "excluded", "avg_judges"]))


def diagnostics_worst(diagnostics: DataFrame, limit: int = 200) -> DataFrame:
    """Of each season, missing first, then the largest difference."""
    return first_of_each(diagnostics.where(F.col("our_points").isNull() | (F.abs("delta") >= EPSILON)), ["season_id"],
                         [F.col("our_points").isNull().desc(), F.abs("delta").desc_nulls_first(), F.asc("team_key")], limit)


def _verdicts(gap: Column, absent: Column) -> list[Column]:
    return [F.count_if(F.coalesce(gap < EPSILON, F.lit(False))).cast("int").alias("agree"),
            F.count_if(F.coalesce(gap >= EPSILON, F.lit(False))).cast("int").alias("differ"),
            F.count_if(absent).cast("int").alias("absent")]


def diagnostics_summary(diagnostics: DataFrame) -> DataFrame:
    agree, differ, absent = _verdicts(F.abs("delta"), F.col("our_points").isNull())
    return diagnostics.groupBy("season_id").agg(F.count("*").cast("int").alias("total"), agree.alias("exact"), differ,
                                                absent.alias("missing"))


def agreement(diagnostics: DataFrame, top: int = 100) -> DataFrame:
    """Four labelled rows per season; the three about totals come from one pass."""
    each = diagnostics.select("season_id", F.explode("results").alias("r")).where(F.col("r.official").isNotNull())
    first = (each.groupBy("season_id").agg(*_verdicts(F.abs(F.col("r.official") - F.col("r.ours")), F.col("r.ours").isNull()))
             .withColumn("label", F.lit("Per-entry results")).withColumn("ord", F.lit(1)))
    high = F.coalesce(F.col("official_rank") <= top, F.lit(False))
    scopes = F.array_compact(F.array(
        F.struct(F.lit(2).alias("ord"), F.lit("Partnership season totals").alias("label")),
        F.when(high, F.struct(F.lit(3).alias("ord"), F.lit(f"Top {top} partnerships").alias("label"))),
        F.when(high, F.struct(F.lit(4).alias("ord"), F.lit(f"Top {top}, within two points").alias("label")))))
    gap, near = F.abs("delta"), F.col("s.ord") == 4
    ok = F.when(near, gap <= 2).otherwise(gap < EPSILON)
    rest = (diagnostics.select("season_id", "delta", "our_points", F.explode(scopes).alias("s"))
            .groupBy("season_id", "s.label", "s.ord")
            .agg(F.count_if(F.coalesce(ok, F.lit(False))).cast("int").alias("agree"),
                 F.count_if(F.coalesce(~ok, F.lit(False))).cast("int").alias("differ"),
                 F.count_if(F.col("our_points").isNull()).cast("int").alias("absent")))
    return first.select("season_id", "ord", "label", "agree", "differ", "absent").unionByName(rest)


def tournament_diagnostics(diagnostics: DataFrame, limit: int = 20) -> DataFrame:
    """Of each season, the tournaments contributing most differing results."""
    r = F.col("r")
    counts = (diagnostics.select("season_id", F.explode("results").alias("r"))
            .where(r["ours"].isNull() | (r["delta"] != 0))
            .groupBy("season_id", r["tournament"].alias("tournament"))
            .agg(F.count("*").cast("int").alias("differing"),
                 F.sum(F.abs(F.coalesce(r["delta"], r["official"], F.lit(0.0)))).alias("points")))
    return first_of_each(counts, ["season_id"], [F.desc("differing"), F.asc("tournament")], limit)


def season_summary(tournaments: DataFrame, totals: DataFrame, debaters: DataFrame, ballots: DataFrame,
                   open_disagreements: DataFrame) -> DataFrame:
    """Five counts per season. ballots: event-level rows with season_id."""
    n = lambda d, name: d.groupBy("season_id").agg(F.count("*").alias(name))
    out = n(tournaments, "tournaments")
    for d, name in ((totals, "teams"), (debaters, "debaters"), (ballots, "ballots"), (open_disagreements, "disagreements")):
        out = out.join(n(d, name), "season_id", "left")
    return out.fillna(0)


def current_ratings(ratings: DataFrame) -> DataFrame:
    return ratings.where(F.col("tournament_id").isNull())


def _points_of_pair(totals: DataFrame) -> DataFrame:
    pair = F.concat_ws("|", F.least("debater1_id", "debater2_id"), F.greatest("debater1_id", "debater2_id"))
    return totals.select("season_id", pair.alias("subject"), F.col("rank").alias("points_rank"), "points",
                         F.col("school_id").alias("team_school"))


def rating_board(ratings: DataFrame, people: DataFrame, totals: DataFrame, schools: DataFrame) -> DataFrame:
    ids = F.split("subject", r"\|")
    out = (current_ratings(ratings).where(F.col("rounds_counted") >= MIN_RATED_ROUNDS)
           .withColumn("debater1_id", ids[0]).withColumn("debater2_id", ids[1]))
    out = (out.join(_people(people, "debater1_id", "debater1"), "debater1_id")
           .join(_people(people, "debater2_id", "debater2"), "debater2_id")
           .join(people.select(F.col("debater_id").alias("debater1_id"), F.col("school_id").alias("_home")), "debater1_id")
           .join(_points_of_pair(totals), ["season_id", "subject"], "left")
           .withColumn("school_id", F.coalesce("team_school", "_home"))
           .join(_schools(schools), "school_id", "left"))
    return out.select("season_id", "subject", "debater1", "debater2", "school", "region", "rating", "deviation",
                      F.col("shrunk_rating").alias("shrunk"), F.col("rounds_counted").alias("rounds"), "points_rank", "points")


def rating_summary(ratings: DataFrame) -> DataFrame:
    current = F.col("tournament_id").isNull()
    gated = current & (F.col("rounds_counted") >= MIN_RATED_ROUNDS)
    return ratings.groupBy("season_id").agg(
        F.count_if(gated).cast("int").alias("ranked"), F.count_if(current).cast("int").alias("total"),
        F.floor(F.coalesce(F.sum(F.when(gated, F.col("rounds_counted"))), F.lit(0)) / 2).cast("int").alias("ranked_rounds"),
        F.count_distinct("tournament_id").cast("int").alias("periods"))


def rating_method_figures(ratings: DataFrame, sides: DataFrame) -> DataFrame:
    """Field spread over *counted* rounds, side figures and counts per season.

    sides: season_id side won decided is_bye, one row per entry per section.
    """
    current = current_ratings(ratings)
    measured = current.where(F.col("rounds_counted") >= MIN_CALIBRATION_ROUNDS)
    counts = ratings.groupBy("season_id").agg(
        F.count_if(F.col("tournament_id").isNull()).cast("int").alias("partnerships"),
        F.count_distinct("tournament_id").cast("int").alias("periods"),
        F.floor(F.coalesce(F.sum(F.when(F.col("tournament_id").isNull(), F.col("rounds_counted"))), F.lit(0)) / 2)
        .cast("int").alias("rounds"))
    won = (sides.where(~F.col("is_bye") & (F.col("decided") > 0) & (F.col("won") * 2 > F.col("decided")))
           .groupBy("season_id").agg((100.0 * F.count_if(F.col("side") == 2) / F.count("*")).alias("opp_win_pct")))
    p = 1 - F.col("opp_win_pct") / 100
    adv = F.when((p > 0) & (p < 1), SCALE * F.ln(p / (1 - p))).otherwise(0.0)
    spread = field_spread(measured, ["season_id"], ["n"]).withColumnRenamed("n", "measured")
    return (counts.join(spread, "season_id", "left").join(won, "season_id", "left")
            .fillna(350.0, ["tau"]).fillna(0, ["measured"]).fillna(0.0, ["opp_win_pct"])
            .withColumn("side_advantage", adv))


def seasons(all_seasons: DataFrame, tournaments: DataFrame) -> DataFrame:
    return (all_seasons.select("season_id").join(tournaments, "season_id", "left").groupBy("season_id")
            .agg(F.count_distinct("tournament_id").cast("int").alias("tournaments"),
                 F.max(F.coalesce("ends_on", "starts_on")).alias("last_result_on")))


def latest_rated_season(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.max("season_id").alias("season_id"))


def freshness(runs: DataFrame, now: Column) -> DataFrame:
    age = (F.unix_micros(now) - F.unix_micros("finished_at")) / 3_600_000_000
    return runs.withColumn("age_hours", age).withColumn("stale", F.col("age_hours") > STALE_HOURS)


def board_order(df: DataFrame, value: Column, interval: str, evidence: str, name: str, by: list[str],
                out: str = "position") -> DataFrame:
    """Position at the printed precision of ``value``, then narrower interval, more evidence, name."""
    return sequence_number(df.withColumn("_shown", value), by, "_shown",
                           [F.asc(interval), F.desc(evidence), F.asc(name)], out).drop("_shown")


def name_search(df: DataFrame, needle: str, names: list[str], school: str | None = None) -> DataFrame:
    """Rows whose names or school contain the words; ranks stay and a withheld name never matches."""
    hit = F.lit(False)
    for c in [*names, *([school] if school else [])]:
        hit = hit | (F.col(c).isNotNull() & F.lower(F.col(c)).contains(needle.lower()))
    return df.where(hit)


def resolve_person(people: DataFrame) -> DataFrame:
    """Every id with its person and whether any of the person's records asked not to be shown."""
    canon = F.coalesce("canonical_id", "debater_id")
    hidden = people.groupBy(canon.alias("person_id")).agg(F.bool_or(F.coalesce("suppressed", F.lit(False))).alias("hidden"))
    return (people.select("debater_id", canon.alias("person_id")).join(hidden, "person_id")
            .select("debater_id", F.when(~F.col("hidden"), F.col("person_id")).alias("person_id")))


def profile_identity(people: DataFrame, schools: DataFrame, debaters: DataFrame, speakers: DataFrame) -> DataFrame:
    named = people.select("debater_id", "school_id", masked_name("first", "last", "suppressed").alias("name"))
    season = debaters.select("season_id", "debater_id", "points", "rank", "auto_qualified")
    speak = speakers.select("season_id", F.col("person_id").alias("debater_id"), F.col("rank").alias("speaker_rank"),
                            "ballots", "mean_display", "margin_display", "mean_raw")
    return (season.join(speak, ["season_id", "debater_id"], "full_outer").join(named, "debater_id")
            .where(F.col("name").isNotNull()).join(_schools(schools), "school_id", "left")
            .withColumn("auto_qualified", F.coalesce("auto_qualified", F.lit(False))).drop("school_id"))


def profile_tournaments(links: DataFrame, canon: DataFrame, people: DataFrame, entries: DataFrame,
                        results: DataFrame, tournaments: DataFrame, schools: DataFrame) -> DataFrame:
    """Every entry of every person with the first partner by name and the result's weight.

    links: entry_id debater_id; entries: entry_id tournament_id school_id prelim_wins
    prelim_losses elim_level won_final; results: entry_id points excluded_reason.
    """
    who = links.join(canon, "debater_id").select("entry_id", "person_id").distinct()
    named = people.select(F.col("debater_id").alias("person_id"), "last",
                          masked_name("first", "last", "suppressed").alias("name"))
    # An entry is a team, so its people fit one row.
    team = (who.join(named, "person_id").groupBy("entry_id")
            .agg(F.array_sort(F.collect_list(F.struct("last", "person_id", "name"))).alias("team")))
    partner = F.get(F.filter("team", lambda t: t["person_id"] != F.col("person_id")), F.lit(0))
    rows = (who.join(team, "entry_id", "left").withColumn("partner", partner).drop("team")
            .join(entries, "entry_id").join(tournaments.select("tournament_id", "season_id", "starts_on", "name"), "tournament_id")
            .join(results.select("entry_id", "points", "excluded_reason"), "entry_id", "left")
            .join(_schools(schools).drop("region"), "school_id", "left"))
    counts = F.col("points").isNotNull() & F.col("excluded_reason").isNull()
    keys = ["season_id", "person_id"]
    weighed = weighted_breakdown(rows.where(counts).select(*keys, "entry_id", "points"), keys, "points", ["entry_id"])
    return (rows.join(weighed.drop("points"), [*keys, "entry_id"], "left").fillna(0.0, ["weight", "contribution"])
            .select(*keys, "tournament_id", "name", "starts_on", "entry_id", "points", "excluded_reason", "weight",
                    "contribution", "prelim_wins", "prelim_losses", "elim_level", "won_final", "school",
                    F.col("partner.person_id").alias("partner_id"), F.col("partner.name").alias("partner_name")))


def profile_rounds(ballots: DataFrame, rounds: DataFrame, entries: DataFrame, categories: DataFrame,
                   scores: DataFrame | None = None) -> DataFrame:
    """Per entry and round: ballots, opponent, the round's largest panel and the walkover's direction.

    The two per-row lookups of the page are aggregates made once: the round's largest
    panel, and a section's two least entries, of which the opponent is the other one.
    ``scores``: entry-level person_id round_id event_id entry_id display raw.
    """
    here = ballots.where(F.col("section_id").isNotNull() & F.col("entry_id").isNotNull())
    side = here.groupBy("event_id", "round_id", "section_id", "entry_id").agg(
        F.max("side").alias("side"), F.count("*").cast("int").alias("ballots"),
        F.count_if("won").cast("int").alias("ballots_won"), F.bool_or("is_bye").alias("bye"))
    panel = side.groupBy("event_id", "round_id").agg(F.max("ballots").alias("round_panel"))
    least = side.groupBy("event_id", "round_id", "section_id").agg(F.min("entry_id").alias("e1"))
    second = (side.join(least, ["event_id", "round_id", "section_id"]).where("entry_id <> e1")
              .groupBy("event_id", "round_id", "section_id").agg(F.min("entry_id").alias("e2")))
    other = F.when(F.col("entry_id") == F.col("e1"), F.col("e2")).otherwise(F.col("e1"))
    per = (side.join(least, ["event_id", "round_id", "section_id"])
           .join(second, ["event_id", "round_id", "section_id"], "left").withColumn("opponent", other)
           .groupBy("event_id", "round_id", "entry_id")
           .agg(F.max("side").alias("side"), F.sum("ballots").cast("int").alias("ballots"),
                F.sum("ballots_won").cast("int").alias("ballots_won"), F.bool_or("bye").alias("bye"),
                F.max("opponent").alias("opponent")))
    mine = entries.select("entry_id", F.col("school_id").alias("my_school"), F.col("elim_level").alias("reached"))
    theirs = entries.select(F.col("entry_id").alias("opponent"), F.col("school_id").alias("their_school"))
    out = (per.join(panel, ["event_id", "round_id"])
           .join(rounds.select("event_id", "round_id", F.col("name").alias("label"), "kind", "elim_level"), ["event_id", "round_id"])
           .join(categories, "event_id", "left").join(mine, "entry_id", "left").join(theirs, "opponent", "left"))
    out = out.withColumn("walkover", walkover_direction(
        "bye", "kind", "elim_level", "category", "my_school", "their_school", "ballots", "round_panel", "reached"))
    if scores is not None:
        spoken = scores.groupBy("event_id", "round_id", "entry_id", "person_id").agg(
            F.avg("display").alias("speaks"), F.avg("raw").alias("raw_speaks"))
        out = out.join(spoken, ["event_id", "round_id", "entry_id"], "left")
    return out.drop("my_school", "their_school", "reached")


def opponent_names(entries: DataFrame, links: DataFrame, canon: DataFrame, people: DataFrame,
                   schools: DataFrame) -> DataFrame:
    """Names and school of each entry, one per person, in name order."""
    named = people.select(F.col("debater_id").alias("person_id"), "last",
                          masked_name("first", "last", "suppressed").alias("name"))
    team = (links.join(canon, "debater_id").select("entry_id", "person_id").distinct().join(named, "person_id")
            .groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct(
                F.col("last").isNull().alias("l0"), "last", "person_id", "name"))).alias("t")))
    visible = F.array_distinct(F.filter(F.transform("t", lambda x: x["name"]), lambda n: n.isNotNull()))
    withheld = F.size(F.filter("t", lambda x: x["name"].isNull()))
    return (entries.select("entry_id", "school_id").join(_schools(schools).drop("region"), "school_id", "left")
            .join(team, "entry_id", "left")
            .select("entry_id", "school", "school_id", F.array_join(visible, " & ").alias("names"), withheld.alias("withheld")))


def profile_partnerships(ratings: DataFrame, totals: DataFrame, people: DataFrame) -> DataFrame:
    """Each person's partnerships with where they sit on the gated board."""
    gated = F.when(F.col("rounds_counted") >= MIN_RATED_ROUNDS, F.col("shrunk_rating"))
    board = competition_rank(current_ratings(ratings).withColumn("_g", gated), ["season_id"], "_g", "rating_rank")
    board = board.join(_points_of_pair(totals).drop("team_school", "points_rank"), ["season_id", "subject"], "left")
    ids = F.split("subject", r"\|")
    each = board.select("season_id", "subject", "rating", "deviation", F.col("shrunk_rating").alias("shrunk"),
                        F.col("rounds_counted").alias("rounds"), "rating_rank", "points",
                        F.explode(F.array(F.struct(ids[0].alias("person_id"), ids[1].alias("partner_id")),
                                          F.struct(ids[1].alias("person_id"), ids[0].alias("partner_id")))).alias("p"))
    return (each.select("p.*", *[c for c in each.columns if c != "p"])
            .join(_people(people, "partner_id", "partner"), "partner_id", "left"))


def round_order(kind: str = "kind", level: str = "elim_level", label: str = "label") -> list[Column]:
    """Sort keys: prelims by number, then eliminations widest first, unknown levels last, then label."""
    elim = F.col(kind) == "elim"
    stage = F.array_position(F.array(*map(F.lit, STAGE_ORDER)), F.col(level))
    number = F.when(F.col(label).rlike(r"^\d+$"), F.col(label).cast("long"))
    return [elim.asc(), F.when(elim, F.coalesce(F.nullif(stage, F.lit(0)), F.lit(len(STAGE_ORDER) + 1))).asc_nulls_first(),
            number.asc_nulls_last(), F.col(label).asc()]


def page_slice(df: DataFrame, page: int, primary: str, ties: list[Column], by: list[str] | None = None,
               size: int = PAGE_SIZE, descending: bool = True) -> DataFrame:
    """Rows of one page of each group with ``current`` and ``total_pages``; a page out of range is clamped."""
    keys = by or []
    numbered = sequence_number(df, keys, primary, ties, "row_no", descending)
    if not keys:
        numbered = numbered.withColumn("_all", F.lit(0))
    group = keys or ["_all"]
    pages = numbered.groupBy(*group).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("total_pages"))
    current = F.least(F.greatest(F.lit(1), F.lit(int(page) or 1)), F.col("total_pages"))
    return (numbered.join(pages, group).withColumn("current", current)
            .where(F.col("row_no").between((F.col("current") - 1) * size + 1, F.col("current") * size)).drop("_all"))


def sender_rate(events: DataFrame, sender: str, ts: str, windows: dict[str, int]) -> DataFrame:
    """Earlier rows of the same sender strictly inside each trailing window, in seconds.

    A sender's time is cut into spans as long as the window, and each span also
    sees a copy of the one before it, so a busy sender is many short groups.
    """
    out = events.withColumn("_us", F.unix_micros(ts))
    for name, seconds in windows.items():
        length = seconds * 1_000_000
        span = F.floor(F.col("_us") / length)
        seen = out.select("*", F.explode(F.array(F.struct(span.alias("span"), F.lit(True).alias("own")),
                                                 F.struct((span + 1).alias("span"), F.lit(False).alias("own")))).alias("_v"))
        frame = W.partitionBy(sender, "_v.span").orderBy("_us").rangeBetween(-length + 1, -1)
        out = seen.withColumn(name, F.count("*").over(frame).cast("int")).where("_v.own").drop("_v")
    return out.drop("_us")


def _stretches(rows: DataFrame, gap_us: int) -> DataFrame:
    """Adds ``stretch``: rows of a sender before and after a silent day do not affect each other.

    Found on hourly summaries, so a busy sender is a short list of hours.
    """
    hourly = (rows.withColumn("_h", F.floor(F.col("_us") / 3_600_000_000)).groupBy("sender", "_h")
              .agg(F.min("_us").alias("lo"), F.max("_us").alias("hi")))
    order = W.partitionBy("sender").orderBy("_h")
    cut = F.coalesce(F.col("lo") - F.lag("hi").over(order) >= gap_us, F.lit(False)).cast("int")
    numbered = hourly.withColumn("_cut", cut).select("sender", "_h", F.sum("_cut").over(order).alias("stretch"))
    return rows.withColumn("_h", F.floor(F.col("_us") / 3_600_000_000)).join(numbered, ["sender", "_h"]).drop("_h")


def sender_decisions(events: DataFrame, sender: str, ts: str, event_id: str, per_hour: int = PER_HOUR,
                     per_day: int = PER_DAY) -> DataFrame:
    """Which rows a limit accepts. A refused row is not stored, so it never counts.

    Each decision depends on the ones before it, so a stretch of one sender is
    read in order by one task, in Arrow batches. What is accepted tells the next
    admissible instant (an hour after the last but few, a day after the last but
    many), so a task jumps from one accepted row to the next, at most ``per_day``
    a day, however busy the sender.
    """
    day, hour = 86_400_000_000, 3_600_000_000
    rows = events.select(F.col(sender).cast("string").alias("sender"), F.col(event_id).cast("long").alias("event"),
                         F.unix_micros(ts).alias("_us"))
    ordered = (_stretches(rows, day).repartition("sender", "stretch")
               .sortWithinPartitions("sender", "stretch", "_us", "event"))

    def decide(batches):
        at, kept = None, []
        for batch in batches:
            times, accepted = batch["_us"].to_numpy(), np.zeros(len(batch), bool)
            runs = batch.groupby(["sender", "stretch"], sort=False, dropna=False).indices
            for key, places in sorted(runs.items(), key=lambda item: item[1][0]):
                if key != at:
                    at, kept = key, []
                here, i = times[places], 0
                while True:
                    free = max(kept[-per_hour] + hour if len(kept) >= per_hour else here[0],
                               kept[-per_day] + day if len(kept) >= per_day else here[0])
                    i = max(i, int(np.searchsorted(here, free)))
                    if i >= len(here):
                        break
                    accepted[places[i]] = True
                    kept = [*kept, int(here[i])][-per_day:]
                    i += 1
            yield batch[["sender", "event"]].assign(accepted=accepted)

    return ordered.mapInPandas(decide, "sender string, event long, accepted boolean").select(
        F.col("sender").cast(events.schema[sender].dataType).alias(sender), F.col("event").alias(event_id), "accepted")
