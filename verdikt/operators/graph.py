"""Connected components by alternating stars (Kiveris et al., 2014).

Each pass points neighbours at the smallest id around them. A node with very
many neighbours costs one partial minimum per task, not a gathered list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verdikt.operators.lineage import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("dst"), F.col("src")))
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    return (both.join(low, "src").where(F.col("dst") > F.col("src"))
            .select(F.col("dst").alias("src"), F.col("low").alias("dst")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("low"))
    moved = down.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.union(low.select("src", F.col("low").alias("dst")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node -> component`` (its smallest id) for every node on an edge ``src dst``."""
    edges = cut_lineage(edges.select("src", "dst").where("src <> dst")
                        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
                        .distinct())
    state = None
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)).where("src <> dst").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))
                        .alias("h")).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("dst").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
