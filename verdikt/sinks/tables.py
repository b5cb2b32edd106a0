"""Writers. Facts and derived tables are partitioned by season."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from verdikt.operators.lineage import shared_root


def overwrite_season(df: DataFrame, path: str, season: str) -> None:
    """Replaces exactly one season's rows and touches no other partition."""
    (df.where(F.col("season_id") == season).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("season_id").parquet(path))


def _swap(df: DataFrame, path: str) -> None:
    """Write beside the table first, then over it: the plan may still be reading the old rows."""
    spark = df.sparkSession
    staged = f"{shared_root(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    spark.read.schema(df.schema).parquet(staged).write.mode("overwrite").parquet(path)


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(like.schema).parquet(path) if fs.exists(fs_path) else None


def upsert_dimension(df: DataFrame, path: str, key: list[str], update: bool = True) -> None:
    """New rows replace old ones of the same key, or with ``update=False`` only add new keys."""
    old = _read(df.sparkSession, path, df)
    if old is None:
        df.write.parquet(path)
        return
    keep, add = (old.join(df.select(*key), key, "left_anti"), df) if update else (
        old, df.join(old.select(*key), key, "left_anti"))
    _swap(keep.unionByName(add), path)


def clear_and_rewrite_scores(scores: DataFrame, season: str, values: DataFrame) -> DataFrame:
    """A season's speaker scores with every normalized value reset, then set where one exists.

    scores: score_id season_id ...; values: score_id z display excluded exclusion_reason.
    Other seasons are not read.
    """
    fresh = scores.where(F.col("season_id") == season).drop("z", "display", "excluded", "exclusion_reason")
    return (fresh.join(values.select("score_id", F.round("z", 4).alias("z"), F.round("display", 3).alias("display"),
                                     "excluded", "exclusion_reason"), "score_id", "left")
            .fillna(False, ["excluded"]))


def record_run(spark: SparkSession, path: str, season: str, tournaments: int, source: str,
               finished_at: Column | None = None) -> None:
    """The run marker, written last."""
    row = spark.createDataFrame([(season, tournaments, source)],
                                "season_id string, tournaments int, source string")
    row = row.withColumn("finished_at", finished_at if finished_at is not None else F.current_timestamp())
    upsert_dimension(row, path, ["season_id"])
