"""Ranks, sequence numbers and best-five weights that never put one group in one task.

A season, a league or a person may own a third of all rows. Rows are therefore dealt into ranges of the whole order,
ties included, with bounds that Spark samples from the rows themselves: an outlier or a value that very many rows share
makes no range larger. Positions are running counts inside a range, plus what lies in the ranges before it. Ranks
count per distinct value first. What is ranked is read several times, so it is first kept as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from verdikt.functions.rules import WEIGHTS
from verdikt.operators.lineage import cut_lineage

def _with_range(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Kept with ``_range``: which stretch of the order of ``by`` and ``order`` a row is in, the first smallest."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(ranges, *by, *order).withColumn("_range", F.spark_partition_id()))


def _before(ranged: DataFrame, by: list[str], amount: Column) -> DataFrame:
    """Sum of ``amount`` over the ranges that come before each range of a group."""
    window = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return (ranged.groupBy(*by, "_range").agg(amount.alias("_in_range"))
            .withColumn("_before", F.coalesce(F.sum("_in_range").over(window), F.lit(0)))
            .drop("_in_range"))


def competition_rank(df: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Highest value first; equal values share the better rank; a null value has none."""
    columns, df = df.columns, cut_lineage(df)
    if not by:
        df, by = df.withColumn("_all", F.lit(0)), ["_all"]
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranged = _with_range(counts, by, [F.desc(value)])
    inside = (W.partitionBy(*by, "_range").orderBy(F.desc(value))
              .rowsBetween(W.unboundedPreceding, -1))
    ranks = (ranged.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
             .join(_before(ranged, by, F.sum("_n")), [*by, "_range"])
             .select(*by, value, (F.col("_inside") + F.col("_before") + 1).alias(out)))
    return df.join(ranks, [*by, value], "left").select(*columns, out)


def sequence_number(df: DataFrame, by: list[str], primary: str, ties: list[Column],
                    out: str = "position", descending: bool = True) -> DataFrame:
    """Position in the order of ``primary`` then ``ties``, without sharing. Null values come last when descending."""
    columns = df.columns
    if not by:
        df, by = df.withColumn("_all", F.lit(0)), ["_all"]
    order = [F.desc(primary) if descending else F.asc(primary), *ties]
    ranged = _with_range(df, by, order)
    inside = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*order))
    return (ranged.withColumn("_inside", inside).join(_before(ranged, by, F.count("*")), [*by, "_range"])
            .select(*columns, (F.col("_inside") + F.col("_before")).cast("int").alias(out)))


def first_of_each(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; ``row_number() <= n`` is pruned in each task before the shuffle."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def best_of(df: DataFrame, keys: list[str], points: str, order: list[str],
            weights: tuple = WEIGHTS) -> DataFrame:
    """The counting results of each key with their place, weight and contribution.

    ``row_number() <= n`` prunes to n rows per key before the shuffle, so a key
    with very many results moves only n per task.
    """
    place = F.row_number().over(
        W.partitionBy(*keys).orderBy(F.desc(points), *[F.asc(c) for c in order]))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("place"))
    return (df.withColumn("place", place).where(F.col("place") <= len(weights))
            .withColumn("weight", weight)
            .withColumn("contribution", F.col(points) * F.col("weight")))


def weighted_breakdown(df: DataFrame, keys: list[str], points: str, order: list[str],
                       weights: tuple = WEIGHTS) -> DataFrame:
    """Every row with its weight and contribution; all but the best five weigh nothing.

    ``order`` breaks ties and, with the keys, identifies a row.
    """
    on = [*keys, *order]
    counted = best_of(df.select(*dict.fromkeys([*on, points])), keys, points, order, weights).select(
        *on, "weight", "contribution")
    return (df.join(counted, on, "left")
            .withColumn("weight", F.coalesce("weight", F.lit(0.0)))
            .withColumn("contribution", F.coalesce("contribution", F.lit(0.0)))
            .select(*df.columns, "weight", "contribution"))


def weighted_total(df: DataFrame, keys: list[str], points: str, order: list[str],
                   weights: tuple = WEIGHTS) -> DataFrame:
    """Sum of the weighted best five, rounded to six places, and how many counted."""
    slim = df.select(*dict.fromkeys([*keys, *order, points]))
    return (best_of(slim, keys, points, order, weights).groupBy(*keys)
            .agg(F.round(F.sum("contribution"), 6).alias("points"),
                 F.count("*").cast("int").alias("tournaments_counted")))
