import datetime as dt
import tempfile

from pyspark.sql import functions as F

from verdikt.operators import boards as Q, glicko as GL, speaks as S
from verdikt.sinks import tables as TB
from verdikt.sources import sheet as SH, refresh as RF
from verdikt.streaming import rating_stream as RS, sender_stream as SS


def fresh():
    return tempfile.mkdtemp(prefix="verdikt-test-")


def test_overwrite_touches_one_season(spark):
    path = fresh() + "/t"
    df = spark.createDataFrame([("2025-26", 1), ("2026-27", 2)], "season_id string, v int")
    TB.overwrite_season(df, path, "2025-26")
    TB.overwrite_season(df, path, "2026-27")
    TB.overwrite_season(df.withColumn("v", F.lit(9)), path, "2026-27")
    assert sorted((r.season_id, r.v) for r in spark.read.parquet(path).collect()) == [("2025-26", 1), ("2026-27", 9)]


def test_upsert_and_run_marker(spark):
    path = fresh() + "/d"
    TB.upsert_dimension(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, ["k"])
    TB.upsert_dimension(spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), path, ["k"])
    TB.upsert_dimension(spark.createDataFrame([("a", 7), ("d", 5)], "k string, v int"), path, ["k"], update=False)
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 3, "c": 4, "d": 5}
    marks = fresh() + "/m"
    TB.record_run(spark, marks, "2025-26", 3, "sheet")
    TB.record_run(spark, marks, "2025-26", 4, "sheet")
    assert [r.tournaments for r in spark.read.parquet(marks).collect()] == [4]


def test_scores_are_reset_within_one_season(spark):
    old = spark.createDataFrame([("s1", "A", 1.0, 2.0, False, None), ("s2", "A", 1.0, 2.0, False, None), ("s3", "B", 1.0, 2.0, False, None)],
                                "score_id string, season_id string, z double, display double, excluded boolean, exclusion_reason string")
    new = spark.createDataFrame([("s1", 0.123456, 27.98765, False, None)], "score_id string, z double, display double, excluded boolean, exclusion_reason string")
    got = {r.score_id: (r.z, r.display) for r in TB.clear_and_rewrite_scores(old, "A", new).collect()}
    assert got == {"s1": (0.1235, 27.988), "s2": (None, None)}


def test_missing_heading_is_an_error(spark):
    grid = spark.createDataFrame([("t", 0, ["A", "B"]), ("t", 1, ["x", "y"]), ("t", 2, ["1", "2"])], "tab string, row_idx int, cells array<string>")
    assert SH.grid_to_table(grid, {"p": "y", "q": "x"}).first().p == "2"
    try:
        SH.grid_to_table(grid, {"p": "z"}).collect()
    except Exception as error:
        assert "column not found: z" in str(error)
    else:
        raise AssertionError("expected an error")


def test_sheet_dates(spark):
    df = spark.createDataFrame([("9/7/25",), ("12/31/2025",), ("soon",)], "d string").select(RF.sheet_date(F.col("d")))
    assert [r[0] for r in df.collect()] == [dt.date(2025, 9, 7), dt.date(2025, 12, 31), None]


def test_judge_shrinks_halfway_at_twelve_ballots(spark):
    pool = [26 + 0.5 * i for i in range(8)] * 3
    rows = [("S", "open", "Cup", f"s{i}", f"d{i}", None, float(v)) for i, v in enumerate(pool)] + [("S", "open", "Cup", f"j{i}", "x", "J", 26.0) for i in range(12)]
    df = spark.createDataFrame(rows, "season_id string, division string, tournament string, score_id string, debater_id string, judge_id string, raw double")
    out = S.normalize_by_judge(S.usable_scores(df)).where("judge_id = 'J'").first()
    stats = S.robust_stats(S.usable_scores(df), ["season_id"], "canonical").first()
    assert abs(out.z * max(0.35, stats.spread / 2) - (26 - (26 + stats.centre) / 2)) < 1e-9


def test_refused_messages_are_not_counted(spark):
    base = dt.datetime(2024, 1, 1)
    at = [0, 10, 20, 30, 61, 62, 71, 200, 201, 202, 203]
    df = spark.createDataFrame([(i, 1, base + dt.timedelta(minutes=m)) for i, m in enumerate(at)], "event_id long, user_id long, ts timestamp")
    got = [r.accepted for r in Q.sender_decisions(df, "user_id", "ts", "event_id").orderBy("event_id").collect()]
    kept, want = [], []
    for m in at:
        ok = sum(k > m - 60 for k in kept) < 3 and sum(k > m - 1440 for k in kept) < 10
        want.append(ok)
        kept += [m] if ok else []
    assert got == want


def test_stream_windows_equal_the_batch(spark):
    src = fresh() + "/e"
    rows = [(1, dt.datetime(2024, 1, 1, 0, m)) for m in (0, 5, 20, 50)] + [(2, dt.datetime(2024, 1, 1, 1, 0))]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp")
    df.write.parquet(src)
    stream = SS.sender_windows(spark.readStream.schema(df.schema).parquet(src), "user_id", "ts")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, SS.sender_windows(df, "user_id", "ts").collect()))


def test_rating_stream_equals_the_batch(spark):
    from test_ratings import contested, make, members_of
    _, df = make(spark, n=12, periods=2)
    src, root = fresh() + "/r", fresh()
    df.coalesce(1).write.parquet(src)
    q = RS.rate_stream(spark.readStream.schema(df.schema).parquet(src), root + "/rounds", root + "/state", root + "/ck")
    q.awaitTermination(180)
    got = {r.subject: round(r.rating, 6) for r in spark.read.parquet(root + "/state").collect()}
    want = {r.subject: round(r.rating, 6) for r in GL.run_season(df, contested(spark, []), members_of(spark, df)).state.collect()}
    assert got == want
