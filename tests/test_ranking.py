"""Ranks and positions against sorting in one place; no range grows with an outlier or a shared value."""

import random

from pyspark.sql import functions as F

from verdikt.operators import ranking as R


def _rows(spark):
    rng = random.Random(3)
    rows = [("s1", f"t{k:04d}", 7.5 if k % 3 == 0 else float(rng.randint(0, 400))) for k in range(3000)]
    rows += [("s1", "far", 1e12), ("s1", "low", -1e12), ("s2", "a", 1.0), ("s2", "b", 1.0), ("s2", "c", 2.0), ("s3", "x", None)]
    return rows, spark.createDataFrame(rows, "season string, name string, value double").repartition(7)


def test_competition_rank(spark):
    rows, df = _rows(spark)
    got = {(r.season, r.name): r.rank for r in R.competition_rank(df, ["season"], "value").collect()}
    for season, name, value in rows:
        better = sum(1 for s, _, v in rows if s == season and v is not None and value is not None and v > value)
        assert got[season, name] == (None if value is None else better + 1)


def test_sequence_number(spark):
    rows, df = _rows(spark)
    for down in (True, False):
        got = {(r.season, r.name): r.position for r in R.sequence_number(df, ["season"], "value", [F.asc("name")], descending=down).collect()}
        for season in ("s1", "s2", "s3"):
            mine = [r for r in rows if r[0] == season]
            mine.sort(key=lambda r: (-(r[2] or 0) if down else (r[2] or 0), r[1]))
            assert [got[season, r[1]] for r in mine] == list(range(1, len(mine) + 1))


def test_no_range_is_large(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows, df = _rows(spark)
        sizes = [r["count"] for r in R._with_range(df, ["season"], [F.desc("value"), F.asc("name")]).groupBy("_range").count().collect()]
        assert sum(sizes) == len(rows) and max(sizes) < 0.2 * len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_first_of_each(spark):
    rows, df = _rows(spark)
    got = R.first_of_each(df.where("value is not null"), ["season"], [F.desc("value"), F.asc("name")], 2)
    assert sorted((r.season, r.name) for r in got.collect()) == [("s1", "far"), ("s1", min(n for s, n, v in rows if s == "s1" and v == 400.0)), ("s2", "a"), ("s2", "c")]


def test_every_order_with_lines_is_a_room(spark):
    from verdikt.plans.driver_tables import DriverTables
    folder = "/root/testdata/sf0.001"
    t = DriverTables(spark, folder)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    assert t.rooms.count() == spark.read.parquet(f"{folder}/orders.parquet").join(lines, "o_orderkey").count()
    assert t.rooms.where("kind = 'elim'").groupBy("event_id").count().agg(F.max("count")).first()[0] <= 15


def test_a_team_in_two_seasons_has_two_totals(spark):
    from verdikt.operators import reconcile as K
    cases = spark.createDataFrame([("s1", "x", "e1", 10.0, 10.0), ("s2", "x", "e2", 20.0, 25.0)], "season_id string, team string, entry_id string, ours double, theirs double").select(
        "*", F.lit(False).alias("unlisted"), (F.col("ours") == F.col("theirs")).alias("matched"), F.lit(False).alias("hybrid"), F.lit(False).alias("broke"),
        F.lit("Regular").alias("category"), F.lit("t").alias("tournament"))
    official = spark.createDataFrame([("s1", "x", 1, "R", 10.0, 1), ("s2", "x", 1, "R", 25.0, 1)], "season_id string, team string, rank int, region string, points double, n_theirs int")
    got = {r.season_id: (r.our_points, r.delta) for r in K.compare_teams(official, cases).collect()}
    assert got == {"s1": (10.0, 0.0), "s2": (20.0, -5.0)}


def test_payload_files_with_numeric_and_text_ids(spark, tmp_path):
    from verdikt.sources import payload as P
    for name, body in (("a", '{"id": 12, "name": "One"}'), ("b", '{"id": "34",\n "name": "Two"}'), ("c", '{"name": "Three"}')):
        (tmp_path / f"{name}.json").write_text(body)
    got = {r.name: r.tournament_id for r in P.read_payloads(spark, str(tmp_path)).collect()}
    assert got == {"One": "12", "Two": "34", "Three": "unknown"}
