from pyspark.sql import functions as F

from verdikt.functions import rules as R, text as T, speaker_scale as SC, labels as L
from verdikt.operators.ranking import competition_rank, sequence_number, weighted_breakdown, weighted_total


def test_bands_at_their_edges(spark):
    sizes = [9, 10, 11, 12, 16, 17, 32, 33, 64, 65, 218, 219, 10000]
    df = spark.createDataFrame([(x,) for x in sizes], "afs int").select("afs", R.afs_band("afs").alias("b"))
    got = {r.afs: r.b for r in df.collect()}
    want = [None, "10-11", "10-11", "12-13", "14-16", "17-19", "28-32", "33-38", "55-64", "65-77", "184-218", "219+", "219+"]
    assert [got[x] for x in sizes] == want


def test_points_by_level_and_unreachable_levels(spark):
    cases = [(10, "first", 17), (79, "first", 29), (145, "first", 32), (219, "tripleOcto", 9), (1000, "first", 35),
             (16, "octo", None), (32, "doubleOcto", None), (64, "tripleOcto", None), (9, "first", None), (17, "octo", 2),
             (33, "doubleOcto", 2), (65, "tripleOcto", 2)]
    df = spark.createDataFrame(cases, "afs int, level string, want int").select("*", R.elim_points("afs", "level").alias("p"))
    assert all(r.p == r.want for r in df.collect())


def test_levels_from_sections(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 8, 13, 16, 32)], "n int").select("n", R.elim_level_from_sections("n").alias("l"))
    got = {r.n: r.l for r in df.collect()}
    assert got[32] == "tripleOcto" and got[16] == "doubleOcto" and got[8] == "octo" and got[1] == "first"
    assert all(got[n] is None for n in (0, 3, 5, 13))


def _score(spark, **k):
    base = {"wins": 5, "losses": 0, "elim_level": "first", "eligible_team_size": True, "walkover_adjustment": 0, "afs": 141,
            "break_pct": 19.2, "prelim_count": 5, "breaking_wins": None, "breaking_losses": None}
    schema = ("wins int, losses int, elim_level string, eligible_team_size boolean, walkover_adjustment int, afs int, break_pct double, "
              "prelim_count int, breaking_wins int, breaking_losses int")
    return R.score_entries(spark.createDataFrame([tuple({**base, **k}.values())], schema)).first()


def test_champions_and_floor(spark):
    r = _score(spark)
    assert (r.base_points, r.break_penalty, r.points) == (32, -1, 31)
    r = _score(spark, afs=59, break_pct=35.6, prelim_count=6)
    assert (r.base_points, r.prelim_count_adjustment, r.points) == (27, 1, 28)
    r = _score(spark, afs=77, break_pct=20.0, walkover_adjustment=-2)
    assert (r.base_points, r.points) == (28, 25)
    r = _score(spark, afs=59, elim_level="octo", wins=4, losses=1, breaking_wins=4, breaking_losses=1, break_pct=20.0)
    assert (r.base_points, r.floor_applied, r.points) == (10, "pointsFloor", 9)
    r = _score(spark, afs=16, elim_level="octo")
    assert r.points == 0 and r.base_points is None
    r = _score(spark, elim_level=None, wins=0, losses=5, walkover_adjustment=-2)
    assert (r.points, r.floor_applied) == (0, "zero")
    assert _score(spark, eligible_team_size=False).excluded == "teamSize"


def test_best_five_against_a_plain_sort(spark):
    import random
    rng = random.Random(11)
    rows = [(k, i, float(rng.randint(0, 6))) for k, n in (("many", 40), ("six", 6), ("few", 3), ("same", 8)) for i in range(n)]
    rows = [(k, i, 5.0 if k == "same" else x) for k, i, x in rows]
    p = spark.createDataFrame(rows, "k string, i int, p double")
    got = {(r.k, r.i): r.weight for r in weighted_breakdown(p, ["k"], "p", ["i"]).collect()}
    totals = {r.k: (r.points, r.tournaments_counted) for r in weighted_total(p, ["k"], "p", ["i"]).collect()}
    for key in ("many", "six", "few", "same"):
        best = sorted((-x, i) for k, i, x in rows if k == key)[:5]
        weights = {i: w for (_, i), w in zip(best, R.WEIGHTS)}
        assert all(got[k, i] == weights.get(i, 0.0) for k, i, _ in rows if k == key)
        assert totals[key] == (round(sum(-x * w for (x, _), w in zip(best, R.WEIGHTS)), 6), len(best))


def test_ranks_against_brute_force(spark):
    import random
    rng = random.Random(5)
    data = [("a" if i % 3 else "b", i, float(rng.choice([1, 2, 2, 2, 3.5, 1e6, rng.random()]))) for i in range(400)]
    df = spark.createDataFrame(data, "g string, i int, v double")
    got = {r.i: r["rank"] for r in competition_rank(df, ["g"], "v").collect()}
    pos = {r.i: r.position for r in sequence_number(df, ["g"], "v", [F.asc("i")]).collect()}
    for g, i, v in data:
        mine = [x for x in data if x[0] == g]
        assert got[i] == 1 + sum(x[2] > v for x in mine)
        assert pos[i] == 1 + sum((-x[2], x[1]) < (-v, i) for x in mine)


def test_edit_distance_counts_a_swap_once(spark):
    pairs = [("marrowby", "marrownby", 1), ("brigde", "bridge", 1), ("smith", "jones", 2), ("same", "same", 0), ("a", "", 1)]
    df = spark.createDataFrame(pairs, "a string, b string, want int").select("*", T.edit_distance_within("a", "b", 1).alias("d"),
                                                                               T.within_one_edit("a", "b").alias("near"))
    assert all(r.d == r.want and r.near == (r.want <= 1) for r in df.collect())


def test_scales(spark):
    df = spark.createDataFrame([(27.5, 25.0, 30.0), (26.5, 23.0, 30.0), (50.0, 0.0, 100.0)], "raw double, lo double, hi double")
    assert {r[0] for r in df.select(SC.to_canonical("raw", "lo", "hi")).collect()} == {27.5}
    df = spark.createDataFrame([(0.0, 25.0, 30.0, "sentinel"), (11.5, 25.0, 30.0, "out-of-range"), (0.0, 0.0, 100.0, None), (24.0, 25.0, 30.0, None)],
                               "raw double, lo double, hi double, want string").select("want", SC.classify_raw("raw", "lo", "hi").alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_label_people(spark):
    df = spark.createDataFrame([("Hill Cara Vale & Rory Hu", None), (None, "Hill VH"), ("x", "Vale & Hu")], "name string, code string")
    got = [[(p.first, p.last) for p in r[0]] for r in df.select(T.people_from_label("name", "code")).collect()]
    assert got == [[("Cara", "Vale"), ("Rory", "Hu")], [], [("", "Vale"), ("", "Hu")]]


def test_masked_names_and_records(spark):
    df = spark.createDataFrame([("A", "B", False), (None, "B", False), ("A", "B", True)], "f string, l string, s boolean")
    assert [r[0] for r in df.select(T.masked_name("f", "l", "s")).collect()] == ["A B", "B", None]
    rec = spark.createDataFrame([(3, 1, 3), (4, 0, 0)], "w int, l int, t int").select(L.record_label("w", "l", "t"))
    assert [r[0] for r in rec.collect()] == ["3–1–3", "4–0"]
