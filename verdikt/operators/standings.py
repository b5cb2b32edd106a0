"""Season totals and ranks of pairs, people and schools."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verdikt.functions.rules import by_season
from verdikt.operators.identity import collapse_partnerships, dominant_school
from verdikt.operators.lineage import cut_lineage
from verdikt.operators.ranking import competition_rank, weighted_total


def scored_results(entry_results: DataFrame, entries: DataFrame, events: DataFrame,
                   tournaments: DataFrame) -> DataFrame:
    """Results that count: not excluded, worth something, with season and schools."""
    return (entry_results.where(F.col("excluded_reason").isNull() & (F.col("points") > 0))
            .select("entry_id", "points")
            .join(entries.select("entry_id", "event_id", "school_id", "hybrid_school_id"), "entry_id")
            .join(events.select("event_id", "tournament_id"), "event_id")
            .join(tournaments.select("tournament_id", "season_id"), "tournament_id"))


def team_totals(results: DataFrame, pairs: DataFrame, people: DataFrame, members: DataFrame) -> DataFrame:
    """Best-five total of each collapsed partnership, with its school and rank."""
    mine = cut_lineage(results.join(pairs.where(F.col("pair").isNotNull()).select("entry_id", "pair"), "entry_id")
                       .select("season_id", "entry_id", "pair", "points", "school_id"))
    home = dominant_school(mine, ["season_id", "pair"], members, "entry_id")
    listed = mine.select("season_id", "pair").distinct().join(home, ["season_id", "pair"], "left")
    collapsed = collapse_partnerships(listed, people, ["season_id"])
    keyed = cut_lineage(mine.join(collapsed, ["season_id", "pair"]))
    keys = ["season_id", "representative"]
    totals = weighted_total(keyed, keys, "points", ["entry_id"])
    school = dominant_school(keyed, keys, members, "entry_id")
    out = totals.join(school, keys, "left").withColumnRenamed("representative", "pair")
    ids = F.split("pair", r"\|")
    return (competition_rank(out, ["season_id"], "points")
            .select("season_id", "pair", ids[0].alias("debater1_id"), ids[1].alias("debater2_id"),
                    "school_id", "points", "tournaments_counted", "rank"))


def debater_totals(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """A person's own best five across partners, and whether it qualifies."""
    mine = (results.select("season_id", "entry_id", "points").join(pairs, "entry_id")
            .select("season_id", "entry_id", "points", F.explode("people").alias("debater_id")))
    totals = weighted_total(mine, ["season_id", "debater_id"], "points", ["entry_id"])
    line = by_season("season_id", lambda r: r.qualify_points, F.lit)
    return (competition_rank(totals, ["season_id"], "points")
            .withColumn("auto_qualified", F.col("points") >= line))


def school_totals(results: DataFrame, members: DataFrame) -> DataFrame:
    """Unweighted member totals; a hybrid result is shared between its two schools."""
    hybrid = F.col("hybrid_school_id").isNotNull()
    each = results.select(
        "season_id", F.explode(F.when(hybrid, F.array("school_id", "hybrid_school_id"))
                               .otherwise(F.array("school_id"))).alias("school_id"),
        (F.col("points") * F.when(hybrid, 0.5).otherwise(1.0)).alias("share"))
    totals = (each.groupBy("season_id", "school_id").agg(F.sum("share").alias("points"))
              .join(members.select("school_id"), "school_id", "left_semi"))
    return competition_rank(totals, ["season_id"], "points")
