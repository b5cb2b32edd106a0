"""Judge-normalized speaker scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verdikt.functions.speaker_scale import classify_raw, scale_for, to_canonical
from verdikt.operators.ranking import sequence_number

# Ballots at which a judge counts half, least ballots for a rank,
# least spread, and the ratio of interquartile range to standard deviation.
SHRINKAGE, MIN_BALLOTS, MIN_SPREAD, IQR_TO_SD, Z95 = 12, 20, 0.35, 1.349, 1.96


def usable_scores(scores: DataFrame) -> DataFrame:
    """Open-division scores on the canonical scale; unusable ones keep the reason.

    scores: score_id debater_id judge_id raw tournament division season_id
    """
    scaled = scores.where(F.col("division") == "open").withColumn("_s", scale_for("tournament"))
    reason = classify_raw("raw", "_s.lo", "_s.hi")
    canonical = F.when(F.col("exclusion_reason").isNull(), to_canonical("raw", "_s.lo", "_s.hi"))
    return (scaled.withColumn("exclusion_reason", reason)
            .withColumn("excluded", F.col("exclusion_reason").isNotNull())
            .withColumn("canonical", canonical).drop("_s"))


def robust_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, spread and count. Equal values are counted first, so a judge with a third of
    all scores reaches the percentile as a short list of distinct values."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("_n"))
    return (counted.groupBy(*keys).agg(quartiles.alias("_q"), F.sum("_n").cast("int").alias("n"))
            .select(*keys, F.col("_q")[1].alias("centre"),
                    ((F.col("_q")[2] - F.col("_q")[0]) / IQR_TO_SD).alias("spread"), "n"))


def normalize_by_judge(usable: DataFrame) -> DataFrame:
    """z and display score; a judge is pulled toward the pool by how few ballots they gave."""
    pool_keys = ["season_id", "division"]
    judge_keys = ["season_id", "division", "judge_id"]
    clean = usable.where(~F.col("excluded"))
    pool = robust_stats(clean, pool_keys, "canonical").select(
        *pool_keys, F.col("centre").alias("pool_centre"), F.col("spread").alias("pool_spread"))
    judge = robust_stats(clean.where(F.col("judge_id").isNotNull()), judge_keys, "canonical")
    n = F.coalesce("n", F.lit(0))
    w = n / (n + SHRINKAGE)
    centre = w * F.coalesce("centre", "pool_centre") + (1 - w) * F.col("pool_centre")
    spread = F.greatest(F.lit(MIN_SPREAD),
                        w * F.coalesce("spread", "pool_spread") + (1 - w) * F.col("pool_spread"))
    # One row per judge, so the score rows meet it without moving when it is small.
    limits = judge.join(pool, pool_keys).select(
        *judge_keys, "pool_centre", "pool_spread", centre.alias("_c"), spread.alias("_s"))
    known = clean.where(F.col("judge_id").isNotNull()).join(limits, judge_keys)
    unknown = clean.where(F.col("judge_id").isNull()).join(
        pool.withColumn("_c", F.col("pool_centre")).withColumn(
            "_s", F.greatest(F.lit(MIN_SPREAD), F.col("pool_spread"))), pool_keys)
    return (known.unionByName(unknown).withColumn("z", (F.col("canonical") - F.col("_c")) / F.col("_s"))
            .withColumn("display", F.col("pool_centre") + F.col("z") * F.col("pool_spread"))
            .drop("_c", "_s"))


def speaker_totals(normalized: DataFrame, canon: DataFrame) -> DataFrame:
    """Per person and season: ballots, mean z, spread, mean raw, display and its 95% margin."""
    # First by registered record, so a very busy judge or person is summed where it lies.
    per_person = (normalized.where(F.col("debater_id").isNotNull())
                  .join(canon, "debater_id", "left")
                  .withColumn("person_id", F.coalesce("person_id", "debater_id")))
    n = F.col("ballots")
    sd = F.when(n > 1, F.col("sd_z")).otherwise(0.0)
    stderr = F.when(n > 1, sd / F.sqrt(n)).otherwise(sd)
    return (per_person.groupBy("season_id", "person_id")
            .agg(F.count("*").cast("int").alias("ballots"), F.avg("z").alias("mean_z"),
                 F.stddev_samp("z").alias("sd_z"), F.avg("canonical").alias("mean_raw"),
                 F.max("pool_centre").alias("pool_centre"), F.max("pool_spread").alias("pool_spread"))
            .select("season_id", "person_id", "ballots", "mean_z", sd.alias("sd_z"), "mean_raw",
                    (F.col("pool_centre") + F.col("mean_z") * F.col("pool_spread")).alias("mean_display"),
                    (Z95 * stderr * F.col("pool_spread")).alias("margin_display")))


def gated_rank(totals: DataFrame, least: int = MIN_BALLOTS) -> DataFrame:
    """Position by mean z among people with enough ballots; nobody else has one."""
    enough = totals.where(F.col("ballots") >= least)
    ranked = sequence_number(enough.select("season_id", "person_id", "mean_z"), ["season_id"], "mean_z",
                             [F.asc("person_id")], "rank")
    return totals.join(ranked.select("season_id", "person_id", "rank"), ["season_id", "person_id"], "left")
