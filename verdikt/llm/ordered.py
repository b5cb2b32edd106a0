"""Running figures over an order that spans tasks, so that one group may hold any share of the rows.

Rows are dealt into ranges of the whole order and numbered there (``AT``, which rises through all ranges). A running
figure is one inside a range, and what its group had in earlier ranges. The order begins with the group, so of each range
only the first group can go on from an earlier one: what is broadcast has at most a row for each range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from verdikt.operators.lineage import cut_lineage

AT = "_at"


def ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, order: list[Column], *columns: Column | str) -> DataFrame:
    """``columns`` of ``df`` and ``AT``, kept as a table."""
    return cut_lineage(df.repartitionByRange(ranges(df), *order).sortWithinPartitions(*order)
                       .select(*columns, F.monotonically_increasing_id().alias(AT)).withColumn("_range", F.shiftright(AT, 33).cast("int")))


def running(rows: DataFrame, by: list[str], figures: dict[str, tuple[Callable[[str], Column], str, Callable[[Column, Column], Column]]]) -> DataFrame:
    """``rows`` of ``in_order`` with a column for each of ``figures``: its aggregate over the rows of a group up to this one.

    A figure is an aggregate function, the column it takes (``*`` with a count), and what joins two of its values.
    """
    window = W.partitionBy("_range", *by).orderBy(AT).rowsBetween(W.unboundedPreceding, 0)
    parts = rows.groupBy(*by, "_range").agg(*[make(column).alias(out) for out, (make, column, _) in figures.items()])
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    gone_before = parts.select(*by, "_range", *[again(make)(out).over(earlier).alias(f"{out}_before") for out, (make, _, _) in figures.items()],
                               F.lag("_range").over(W.partitionBy(*by).orderBy("_range")).alias("_from")).where("_from IS NOT NULL").drop("_from")
    inside = rows.select("*", *[make(column).over(window).alias(out) for out, (make, column, _) in figures.items()])
    joined = inside.join(F.broadcast(gone_before), [*by, "_range"], "left")
    return joined.select(*rows.columns, *[
        F.when(F.col(f"{out}_before").isNull(), F.col(out)).otherwise(join(F.col(out), F.col(f"{out}_before"))).alias(out)
        for out, (_, _, join) in figures.items()])


def again(make: Callable[[str], Column]) -> Callable[[str], Column]:
    """What sums up the parts of an aggregate: counts are added."""
    return F.sum if make is F.count else make
