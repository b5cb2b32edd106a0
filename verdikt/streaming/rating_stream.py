"""Ratings kept up to date as finished tournaments arrive.

Each micro-batch carries all rated rounds of tournaments that finished or were corrected. Their rows replace what was
stored of them, so a section that a correction withdraws is gone. The seasons touched are then run again from their first
period, which gives what the batch job would; other seasons are not read. The state table holds each season's last state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from verdikt.operators.glicko import Options, Run, VALIDATED, run_season
from verdikt.operators.lineage import cut_lineage

ROUND_KEY = ["season_id", "section_id"]


def apply_batch(spark: SparkSession, batch: DataFrame, rounds_path: str, options: Options = VALIDATED,
                contested_path: str | None = None) -> Run:
    """Stores the batch's tournaments and reruns the seasons it touches.

    Of copies of a section the one that arrived last counts, by the column ``arrived`` if the batch has one. Rounds are
    kept by season and tournament, and only the partitions in the batch are written. ``contested_path`` is the table of
    contested rounds that the load keeps; without it nobody has contested any.
    """
    if "arrived" in batch.columns:
        rest = [c for c in batch.columns if c not in ROUND_KEY]
        batch = batch.groupBy(*ROUND_KEY).agg(F.max_by(F.struct(*rest), "arrived").alias("r")).select(*ROUND_KEY, "r.*").drop("arrived")
    else:
        batch = batch.dropDuplicates(ROUND_KEY)
    fresh = cut_lineage(batch)
    (fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("season_id", "tournament_id").parquet(rounds_path))
    touched = fresh.select("season_id").distinct()
    rounds = spark.read.schema(fresh.schema).parquet(rounds_path).join(touched, "season_id", "left_semi")
    members = (rounds.select("season_id", F.explode(F.array("a", "b")).alias("subject")).distinct()
               .select("season_id", "subject", F.explode(F.split("subject", r"\|")).alias("debater_id")))
    none = rounds.select("season_id", "period_seq", "period_id", "tournament_id", "date",
                         F.col("a").alias("subject"), F.lit(0).alias("contested")).limit(0)
    contested = none
    if contested_path is not None:
        contested = spark.read.schema(none.schema).parquet(contested_path).join(touched, "season_id", "left_semi")
    return run_season(rounds, contested, members, options)


def rate_stream(rounds: DataFrame, rounds_path: str, state_path: str, checkpoint: str,
                options: Options = VALIDATED, contested_path: str | None = None) -> StreamingQuery:
    """Starts the stream; the state table is rewritten season by season after every batch."""

    def on_batch(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        run = apply_batch(spark, batch, rounds_path, options, contested_path)
        (run.state.select("season_id", "subject", "rating", "deviation", "volatility", "rounds", "contested",
                          "periods", "last_date")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season_id")
         .parquet(state_path))

    return (rounds.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
