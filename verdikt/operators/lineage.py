"""Cutting the lineage of iterative jobs through tables in the cluster's shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where a session sets none, one in its warehouse, if executors share that too.

    On a cluster a warehouse on a machine's own disk is no such place, and is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        own_disk = warehouse.startswith("file:") or "://" not in warehouse
        if own_disk and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{warehouse}/_steps/{spark.sparkContext.applicationId}"
    return root.rstrip("/")


# Fixed value: what rows in memory are taken for against their files. Ballots were 13 times as Arrow; Spark's rows are wider.
UNPACKED = 20.0


def weigh_unpacked(spark: SparkSession) -> None:
    """Let the planner weigh files by the rows they hold.

    It takes a table for as large as its files and broadcasts it below a limit. Files of repeated ids are a small part
    of their rows, so that a table of millions of rows would pass for a small one and fill the driver.
    """
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name, "1.0")) < UNPACKED:
        spark.conf.set(name, str(UNPACKED))


def cut_lineage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The step is computed once, survives the loss of any executor, and the
    table's size tells the planner whether the next join may broadcast it.
    """
    spark = df.sparkSession
    weigh_unpacked(spark)
    path = f"{shared_root(spark)}/step-{uuid.uuid4().hex}"
    writer = df.repartition(*partition_by).write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
