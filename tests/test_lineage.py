"""Where step tables may lie."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from verdikt.operators.lineage import cut_lineage, shared_root


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, *default: conf.get(key.replace(".", "_"), *default) if default else conf[key.replace(".", "_")]),
                           sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_the_checkpoint_folder_is_taken_where_it_is_set():
    assert shared_root(session("yarn", spark_checkpoint_dir="hdfs://x/c/")) == "hdfs://x/c"


def test_a_shared_warehouse_will_do_and_a_machines_own_only_in_local_mode():
    assert shared_root(session("yarn", spark_sql_warehouse_dir="hdfs://x/w")) == "hdfs://x/w/_steps/app"
    for master in ("local", "local[8]", "local[*]"):
        assert shared_root(session(master, spark_sql_warehouse_dir="file:/w/")) == "file:/w/_steps/app"
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]", "k8s://x"):
        for place in ("file:/w", "file:///w", "/w"):
            with pytest.raises(ValueError):
                shared_root(session(master, spark_sql_warehouse_dir=place))


def test_rows_that_pack_well_are_not_broadcast_for_their_small_files(spark):
    named = lambda n: cut_lineage(spark.range(n).select("id", F.concat(F.lit("2024-01-01:open:" * 4), (F.col("id") % 100).cast("string")).alias("k")))
    large, small = named(400_000), named(100)
    plan = lambda other: large.select("id", F.lit(1).alias("x")).join(other, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(large)
    assert "BroadcastHashJoin" in plan(small)
