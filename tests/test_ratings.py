import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdikt.operators import bradley_terry as BT, glicko as GL, sections as X, validation as V
from verdikt.plans import rating_queries as RQ

ROUND = ("season_id string, section_id string, period_seq int, period_id string, tournament_id string, date date, a string, b string, "
         "won_a int, ballots int, side_a int")


def make(spark, seed=4, n=60, periods=4):
    rng = random.Random(seed)
    subjects = ["a|b", "c|d", "e|f", "a|c", "b|e"]
    rows = []
    for i in range(n):
        p = 1 + i * periods // n
        a, b = rng.sample(subjects, 2)
        rows.append(("S", f"r{i:03d}", p, f"p{p}", f"t{p}", dt.date(2025, 1, 1) + dt.timedelta(days=10 * p), a, b, rng.choice([0, 1, 3]), 3, rng.choice([1, 2])))
    return rows, spark.createDataFrame(rows, ROUND)


def members_of(spark, df):
    return (df.select("season_id", F.explode(F.array("a", "b")).alias("subject")).distinct()
            .select("season_id", "subject", F.explode(F.split("subject", r"\|")).alias("debater_id")))


def contested(spark, rows):
    return spark.createDataFrame(rows, "season_id string, period_seq int, period_id string, tournament_id string, date date, subject string, contested int")


def test_published_worked_example(spark):
    d = spark.createDataFrame([("s", 1500.0, 200.0, 0.06, r, dv, s, 0.0) for r, dv, s in [(1400.0, 30.0, 1.0), (1550.0, 100.0, 0.0), (1700.0, 300.0, 0.0)]],
                              "subject string, rating double, deviation double, volatility double, their_rating double, their_deviation double, score double, advantage double")
    s = GL.evidence(d).groupBy("subject", "rating", "deviation", "volatility").agg(F.sum("info").alias("v_inv"), F.sum("pull").alias("delta_sum"))
    r = GL.glicko_update(s, GL.Options(tau=0.5)).first()
    assert abs(r.rating - 1464.06) < 0.05 and abs(r.deviation - 151.52) < 0.005 and abs(r.volatility - 0.05999) < 5e-5


def test_ballot_scores(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (2, 3), (2, 4), (0, 0)], "w int, n int")
    full = [r[0] for r in df.select(GL.ballot_score("w", "n", 1.0)).collect()]
    plain = [r[0] for r in df.select(GL.ballot_score("w", "n", 0.0)).collect()]
    assert np.allclose(full, [1, 0, 2 / 3, 0.5, 0.5]) and plain == [1, 0, 1, 0.5, 0.5]


def reference_run(rows, tau=0.4, pairing=180.0):
    """Period by period in plain Python, from the published description."""
    S = 173.7178
    g = lambda phi: 1 / math.sqrt(1 + 3 * phi * phi / math.pi ** 2)
    state, people, who = {}, {}, {}

    def at(subject, day):
        if subject in state:
            r, d, v, last = state[subject]
            weeks = max(0, (day - last).days / 7)
            return r, min(350.0, math.sqrt((d / S) ** 2 + v * v * weeks) * S), v
        known = [people[m] for m in subject.split("|") if m in people]
        if not known:
            return 1500.0, 350.0, 0.06
        both = [people.get(m, (1500.0, 350.0, 0.06)) for m in subject.split("|")]
        blur = math.sqrt(sum(p[1] ** 2 for p in both)) / len(both)
        return (sum(p[0] for p in both) / len(both), min(350.0, math.hypot(max(blur, min(k[1] for k in known)), pairing)),
                sum(k[2] for k in known) / len(known))

    for p in sorted({r[2] for r in rows}):
        mine = [r for r in rows if r[2] == p]
        day = mine[0][5]
        before = {s: at(s, day) for r in mine for s in (r[6], r[7])}
        games = {}
        for r in mine:
            s = r[8] / r[9]
            games.setdefault(r[6], []).append((before[r[7]], s))
            games.setdefault(r[7], []).append((before[r[6]], 1 - s))
        new = {}
        for subject, opp in games.items():
            r0, d0, v0 = before[subject]
            mu, phi = (r0 - 1500) / S, d0 / S
            vinv = pull = 0.0
            for (ro, do, _), s in opp:
                k = g(do / S)
                e = 1 / (1 + math.exp(-k * (mu - (ro - 1500) / S)))
                vinv += k * k * e * (1 - e)
                pull += k * (s - e)
            v, delta = 1 / vinv, pull / vinv
            f = lambda x: (math.exp(x) * (delta ** 2 - phi ** 2 - v - math.exp(x)) / (2 * (phi ** 2 + v + math.exp(x)) ** 2)
                           - (x - math.log(v0 ** 2)) / tau ** 2)
            lo, hi = -60.0, 10.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if f(mid) > 0 else (lo, mid)
            sig = math.exp(lo / 2)
            star = phi ** 2 + sig ** 2
            out = 1 / math.sqrt(1 / star + vinv)
            new[subject] = ((mu + out ** 2 * pull) * S + 1500, min(350.0, out * S), sig, day)
        state.update(new)
        for m in {m for s in state for m in s.split("|")}:
            seen = [at(s, day) for s in state if m in s.split("|")]
            w = [1 / x[1] ** 2 for x in seen]
            people[m] = (sum(a * x[0] for a, x in zip(w, seen)) / sum(w), min(350.0, math.sqrt(1 / sum(w))), sum(x[2] for x in seen) / len(seen))
    return state


def test_season_equals_the_sequential_run(spark):
    rows, df = make(spark)
    run = GL.run_season(df, contested(spark, []), members_of(spark, df), predict=True)
    want = reference_run(rows)
    got = {r.subject: r for r in run.state.collect()}
    assert set(got) == set(want)
    for s, (r, d, v, last) in want.items():
        assert abs(got[s].rating - r) < 1e-3 and abs(got[s].deviation - d) < 1e-3 and abs(got[s].volatility - v) < 1e-6
        assert got[s].last_date == last
    assert run.predictions.count() == len(rows)


def test_contested_rounds_move_the_count_only(spark):
    rows, df = make(spark, n=20, periods=2)
    day = dt.date(2025, 1, 21)
    extra = contested(spark, [("S", 2, "p2", "t2", day, "x|y", 3)])
    run = GL.run_season(df, extra, members_of(spark, df))
    r = {x.subject: x for x in run.state.collect()}["x|y"]
    assert (r.rating, r.deviation, r.rounds, r.contested, r.periods) == (1500.0, 350.0, 0, 3, 0)


def test_side_advantage(spark):
    rows = [("S", str(i), 1, 1, s) for i, s in enumerate([1, 2, 2, 2])]
    df = spark.createDataFrame(rows, "season_id string, section_id string, won_a int, ballots int, side_a int")
    r = X.side_advantage(df, ["season_id"]).first()
    assert r.side_advantage < 0
    even = X.side_advantage(df.where("section_id in ('0', '1')"), ["season_id"]).first()
    assert even.side_advantage == 0


def test_elo_equals_the_sequential_pass(spark):
    rows, df = make(spark, n=30)
    got = {r.section_id: (r.ra, r.rb) for r in V.elo(df, 32.0, most=3).collect()}
    at = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        a, b = at.get(r[6], 1500.0), at.get(r[7], 1500.0)
        assert abs(got[r[1]][0] - a) < 1e-9 and abs(got[r[1]][1] - b) < 1e-9
        s = 1.0 if 2 * r[8] > r[9] else 0.0
        gain = 32 * (s - 1 / (1 + 10 ** ((b - a) / 400)))
        at[r[6]], at[r[7]] = a + gain, b - gain


def test_bradley_terry_ends_where_plain_descent_does(spark):
    rows, df = make(spark, n=40)
    strengths, fits = BT.fit_bradley_terry(BT.bt_rounds(df), ["season_id"], 1.5)
    names = sorted({r[6] for r in rows} | {r[7] for r in rows})
    ix = {n: i for i, n in enumerate(names)}
    s, side, rate = np.zeros(len(names)), 0.0, 0.5
    z = lambda s, side: np.array([s[ix[r[6]]] - s[ix[r[7]]] + side * (1 if r[10] == 1 else -1) for r in rows])
    y = np.array([r[8] / r[9] for r in rows])
    loss = lambda s, side: np.sum(np.logaddexp(0, z(s, side)) - z(s, side) * y) + 0.75 * np.sum(s ** 2)
    now = loss(s, side)
    for _ in range(3000):
        off = 1 / (1 + np.exp(-z(s, side))) - y
        grad = 1.5 * s
        for r, o in zip(rows, off):
            grad[ix[r[6]]] += o
            grad[ix[r[7]]] -= o
        gside = sum(o * (1 if r[10] == 1 else -1) for r, o in zip(rows, off))
        while loss(s - rate * grad, side - rate * gside) > now and rate > 1e-12:
            rate /= 2
        s, side = s - rate * grad, side - rate * gside
        now = loss(s, side)
    got = {r.subject: r.strength for r in strengths.collect()}
    assert all(abs(got[n] - s[ix[n]]) < 1e-4 for n in names)
    assert abs(fits.first().side_term - side) < 1e-4
    assert abs(fits.first().loss - now) < 1e-7 and fits.first().iterations < 60


def newton(rounds, penalty):
    """Strengths by name and the side term at the optimum, by exact Newton steps. rounds: a's ids, b's ids, score, first side."""
    ix = {n: i for i, n in enumerate(sorted({n for a, b, _, _ in rounds for n in a + b}))}
    m = np.zeros((len(rounds), len(ix) + 1))
    for row, (a, b, _, first) in zip(m, rounds):
        for ids, sign in ((a, 1), (b, -1)):
            for n in ids:
                row[ix[n]] += sign
        row[-1] = 1 if first else -1
    y, weight, x = np.array([r[2] for r in rounds]), np.array([penalty] * len(ix) + [0.0]), np.zeros(len(ix) + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-(m @ x)))
        x = x - np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + np.diag(weight), m.T @ (p - y) + weight * x)
    return {n: x[i] for n, i in ix.items()}, x[-1]


def test_lanes_end_where_fits_of_their_own_rounds_do(spark):
    rows, df = make(spark, n=40, periods=5)
    more, other = make(spark, seed=9, n=20, periods=3)
    df = df.union(other.withColumn("season_id", F.lit("T")))
    lanes = [BT.Lane("p3", 2.0, 3), BT.Lane("none", 1.0, 1), BT.Lane("all", 4.0)]
    strengths, fits = BT.fit_lanes(BT.bt_rounds(df, 1.0, "people"), ["season_id"], lanes, gradient=1e-8)
    got = {(r.season_id, r.lane, r.subject): r.strength for r in strengths.collect()}
    sides = {(r.season_id, r.lane): r.side_term for r in fits.collect()}
    for season, games in (("S", rows), ("T", more)):
        for lane in lanes:
            own = [(r[6].split("|"), r[7].split("|"), r[8] / r[9], r[10] == 1) for r in games if lane.before is None or r[2] < lane.before]
            alone, side = newton(own, lane.penalty) if own else ({}, 0.0)
            assert all(abs(x - alone.get(subject, 0.0)) < 1e-6 for (s, name, subject), x in got.items() if (s, name) == (season, lane.name))
            assert abs(sides[season, lane.name] - side) < 1e-6


def test_walk_forward_strengths_know_only_earlier_periods(spark):
    rows, df = make(spark, n=48, periods=4)
    got = {r.section_id: r.p_a for r in V.bt_models(df, "pairs", 2.0).collect()}
    assert set(got) == {r[1] for r in rows if r[2] >= 2}
    for p in (2, 4):
        x, side = newton([([r[6]], [r[7]], r[8] / r[9], r[10] == 1) for r in rows if r[2] < p], 2.0)
        for r in rows:
            if r[2] == p:
                z = x.get(r[6], 0.0) - x.get(r[7], 0.0) + side * (1 if r[10] == 1 else -1)
                assert abs(got[r[1]] - 1 / (1 + np.exp(-z))) < 1e-6


def test_fits_of_a_season_do_not_learn_from_another(spark):
    rng = random.Random(3)
    rows = [(season, i, rng.choice([-1.0, 1.0]), rng.random()) for season in ("A", "B", "few") for i in range(200 if season != "few" else 12)]
    rows = [(s, i, x, int(u < (0.8 if (x > 0) == (s == "A") else 0.2))) for s, i, x, u in rows]
    df = spark.createDataFrame(rows, "season_id string, i int, x double, y int")
    betas = V.fit_logistics(df, ["x"], ["season_id"])
    assert betas["few",] == [0.0, 0.0] and betas["A",][1] > 0.8 and betas["B",][1] < -0.8
    for season in "AB":
        alone = V.fit_logistic(df.where(F.col("season_id") == season), ["x"])
        assert np.allclose(alone, betas[season,], atol=1e-9)
    p = {(r.season_id, r.x): r.p_a for r in V.with_logistic(df.union(spark.createDataFrame([("new", 1, 1.0, 1)], df.schema)), ["x"], ["season_id"], betas).collect()}
    assert p["new", 1.0] == 0.5 and p["few", 1.0] == 0.5
    for s, x in (("A", 1.0), ("B", -1.0)):
        won = [y for t, _, z, y in rows if (t, z) == (s, x)]
        assert abs(p[s, x] - sum(won) / len(won)) < 1e-6


def test_bootstrap_is_by_season(spark):
    rows = [(s, f"{s}{i}", 0.7 if s == "A" else 0.3, 0.5) for s in "AB" for i in range(60)]
    got = {r.season_id: r for r in V.paired_bootstrap(spark.createDataFrame(rows, "season_id string, section_id string, p_one double, p_two double"), draws=50).collect()}
    assert (got["A"].gap, got["A"].lo, got["A"].hi, got["A"].share_worse) == (0.5, 0.5, 0.5, 0.0)
    assert (got["B"].gap, got["B"].share_worse, got["B"].draws) == (-0.5, 1.0, 50)


def test_logistic_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + 1.2 * x)))).astype(int)
    beta = V.fit_logistic(spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int"), ["x"])
    p = 1 / (1 + np.exp(-(beta[0] + beta[1] * x)))
    assert abs(np.sum(y - p)) < 1e-3 and abs(np.sum((y - p) * x)) < 1e-3
    assert V.fit_logistic(spark.createDataFrame([(1.0, 1)], "x double, y int"), ["x"]) == [0.0, 0.0]


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_elo_plays_seasons_and_variants_side_by_side(spark, most):
    rows, df = make(spark, n=40, periods=3)
    more, other = make(spark, seed=8, n=25, periods=2)
    df = df.union(other.withColumn("season_id", F.lit("T")))
    got = {(r.season_id, r.variant, r.section_id): (r.ra, r.rb) for r in V.elo(df, {"low": 8.0, "high": 64.0}, 1.0, most).collect()}
    assert len(got) == 2 * 65
    for season, games in (("S", rows), ("T", more)):
        for name, k in (("low", 8.0), ("high", 64.0)):
            at = {}
            for r in sorted(games, key=lambda r: (r[2], r[1])):
                a, b = at.get(r[6], 1500.0), at.get(r[7], 1500.0)
                assert np.allclose(got[season, name, r[1]], (a, b), atol=1e-9)
                gain = k * (r[8] / r[9] - 1 / (1 + 10 ** ((b - a) / 400)))
                at[r[6]], at[r[7]] = a + gain, b - gain


def test_elo_of_no_rounds(spark):
    _, df = make(spark, n=1)
    assert V.elo(df.where("false"), 32.0).collect() == []


def test_elo_query_carries_ratings_through_a_season(spark, monkeypatch):
    rows, df = make(spark, n=16, periods=2)
    monkeypatch.setattr(RQ, "rated", lambda t: df)
    got, at = {r.section_id: r for r in RQ.elo(None).collect()}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        a, b = at.get(r[6], 1500.0), at.get(r[7], 1500.0)
        gain = 48 * ((1.0 if 2 * r[8] > r[9] else 0.0) - 1 / (1 + 10 ** ((b - a) / 400)))
        assert got[r[1]].season_id == "S" and np.allclose((got[r[1]].ra, got[r[1]].rb, got[r[1]].gain), (a, b, gain))
        at[r[6]], at[r[7]] = a + gain, b - gain


def test_sweeps_run_their_whole_grids(spark, monkeypatch):
    _, df = make(spark, n=36, periods=9)
    monkeypatch.setattr(RQ, "rated", lambda t: df)
    monkeypatch.setattr(RQ, "contested", lambda t: contested(spark, []))
    monkeypatch.setattr(RQ, "members", lambda t: members_of(spark, df))
    got = [(r.variant, r.log_loss) for r in RQ.option_sweep(None).collect()]
    grid = [(v, x) for v, x in got if v in V.sweep_options(1.0)]
    assert len(grid) == 12 and got == sorted(got, key=lambda r: (r[1], r[0]))
    more = {f"{grid[0][0]}, pairing RD {d:g}" for d in V.PAIRING_SWEEP} if "seeded" in grid[0][0] else set()
    assert {v for v, _ in got} - {v for v, _ in grid} == more
    assert {r.variant for r in RQ.elo_sweep(None).collect()} == {f"K={k:g}" for k in V.K_SWEEP}


def test_iterated_ratings_take_three_passes(spark, monkeypatch):
    _, df = make(spark, n=6, periods=1)
    monkeypatch.setattr(RQ, "rated", lambda t: df)
    monkeypatch.setattr(RQ, "contested", lambda t: contested(spark, []))
    monkeypatch.setattr(RQ, "members", lambda t: members_of(spark, df))
    run, passes = GL.run_season, []
    monkeypatch.setattr(GL, "run_season", lambda *a, **k: passes.append(1) or run(*a, **k))
    assert RQ.iterated_ratings(None).count() > 0 and len(passes) == 3


def test_sections_of_tallied_sides_are_those_of_their_ballots(spark):
    """Sides counted in the rooms' own table give what every ballot, counted and looked up, gives."""
    from verdikt.plans.driver_tables import DriverTables
    t = DriverTables(spark, "/root/testdata/sf0.001")
    entries = t.entries.select("entry_id", "school_id").join(t.pairs.select("entry_id", "pair"), "entry_id")
    plain = X.section_sides(X.count_sides(t.ballots), t.rounds, t.events, t.tournaments, entries)
    lean = X.section_sides(t.side_counts)
    assert sorted(plain.columns) == sorted(lean.columns)
    assert plain.exceptAll(lean.select(*plain.columns)).count() == lean.select(*plain.columns).exceptAll(plain).count() == 0


def ladder(spark, n):
    """Rounds between neighbours on a ladder: each waits for the one before it, and nobody plays more than two."""
    return spark.createDataFrame([("S", f"{i:04d}", 1, f"p{i:04d}", f"p{i + 1:04d}", 1, 1) for i in range(n)],
                                 "season_id string, section_id string, period_seq int, a string, b string, won_a int, ballots int")


def jobs_of(spark, make):
    sc = spark.sparkContext
    group = f"jobs of {make}"
    sc.setJobGroup(group, group)
    try:
        got = make()
        return got, len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc._jsc.clearJobGroup()


def test_elo_takes_no_pass_for_every_round_that_waits(spark):
    """Rounds that wait for each other are played as they stand: jobs follow stretches, not the longest chain."""
    few, short = jobs_of(spark, lambda: V.elo(ladder(spark, 6), 32.0, most=1000).collect())
    many, long = jobs_of(spark, lambda: V.elo(ladder(spark, 36), 32.0, most=1000).collect())
    assert (len(few), len(many)) == (6, 36) and long <= short + 4
    rating = 1500.0
    for r in sorted(many, key=lambda r: r.section_id):
        assert abs(r.ra - rating) < 1e-9 and r.rb == 1500.0
        rating = r.rb - r.gain
    cut = {r.section_id: (r.ra, r.rb) for r in V.elo(ladder(spark, 36), 32.0, most=18).collect()}
    assert cut == {r.section_id: (r.ra, r.rb) for r in many}


def test_strengths_come_to_rounds_that_stay(spark, monkeypatch):
    """A pass writes rows by subject, none by round: with as many subjects, ten times the rounds write no more rows. The joins by shuffle agree."""
    rows, few = make(spark, n=30)
    _, many = make(spark, n=300)
    written = []

    def kept(df, *by, cut=BT.cut_lineage):
        out = cut(df, *by)
        written.append(out.count())
        return out

    monkeypatch.setattr(BT, "cut_lineage", kept)
    counts = []
    for df in (few, many):
        written.clear()
        BT.fit_lanes(BT.bt_rounds(df, 1.0, "people"), ["season_id"], [BT.Lane("all", 2.0)], iterations=3)
        counts.append(written[1:])  # the first is the rounds themselves, once
    assert max(counts[1]) == max(counts[0]) < 30
    strengths, fits = BT.fit_lanes(BT.bt_rounds(few), ["season_id"], [BT.Lane("all", 2.0)])
    monkeypatch.setattr(BT, "BROADCAST", 0)
    again, same = BT.fit_lanes(BT.bt_rounds(few), ["season_id"], [BT.Lane("all", 2.0)])
    theirs = {r.subject: r.strength for r in again.collect()}
    assert all(abs(theirs[r.subject] - r.strength) < 1e-9 for r in strengths.collect()) and len(theirs) == 5


def test_pairs_and_people_descend_together(spark):
    rows, df = make(spark, n=48, periods=4)
    got = {(r.unit, r.section_id): r.p_a for r in V.bt_models(df, ("pairs", "people"), 2.0).collect()}
    assert set(got) == {(u, r[1]) for u in ("pairs", "people") for r in rows if r[2] >= 2}
    for unit, ids in (("pairs", lambda s: [s]), ("people", lambda s: s.split("|"))):
        x, side = newton([(ids(r[6]), ids(r[7]), r[8] / r[9], r[10] == 1) for r in rows if r[2] < 4], 2.0)
        for r in (r for r in rows if r[2] == 4):
            z = sum(x.get(i, 0.0) for i in ids(r[6])) - sum(x.get(i, 0.0) for i in ids(r[7])) + side * (1 if r[10] == 1 else -1)
            assert abs(got[unit, r[1]] - 1 / (1 + np.exp(-z))) < 1e-6


@pytest.mark.parametrize("held", [1, 7, 50_000])
def test_pulls_are_the_same_however_many_a_task_holds(monkeypatch, held):
    monkeypatch.setattr(BT, "HELD", held)
    rng, lanes = np.random.default_rng(2), 3
    before, terms, signs = np.array([2.0, 3.0, math.inf]), rng.normal(size=(2, lanes)), [1.0, 1.0, -1.0]
    rounds = [(int(rng.integers(2)), float(rng.integers(2)), float(rng.choice([-1, 1])), float(rng.integers(1, 4)), "a", rng.choice(["b", None]), str(rng.choice(["c", "d"])),
               *[rng.normal(size=lanes) for _ in signs]) for _ in range(40)]
    names = ["_fit", "score", "side", "period", "id0", "id1", "id2", "x0", "x1", "x2"]
    batch = lambda part: pa.RecordBatch.from_pydict({n: [list(r[i]) if n[0] == "x" else r[i] for r in part] for i, n in enumerate(names)},
                                                    pa.schema([("_fit", pa.int32()), *[(n, pa.float64()) for n in names[1:4]], *[(n, pa.string()) for n in names[4:7]],
                                                               *[(n, pa.list_(pa.float64())) for n in names[7:]]]))
    want, got = {}, {}
    for f, score, side, period, *rest in rounds:
        z = side * terms[f] + sum(s * x for s, x in zip(signs, rest[3:]))
        off = (period < before) * (1 / (1 + np.exp(-z)) - score)
        for key, value in ((("side", None), off * side), (("loss", None), (period < before) * (np.log1p(np.exp(z)) - z * score)),
                           *[(("subject", i), s * off) for s, i in zip(signs, rest[:3]) if i is not None]):
            want[f, *key] = want.get((f, *key), 0) + value
    for out in BT._pulled(signs, before, terms)([batch(rounds[:15]), batch([]), batch(rounds[15:])]):
        for r in out.to_pylist():
            key = (r["_fit"], r["kind"], r["subject"])
            got[key] = got.get(key, 0) + np.array(r["values"])
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_one_run_tells_both_predictions(spark):
    rng, subjects = random.Random(8), [f"m{i}|n{i}" for i in range(24)]
    rows = [("S", f"r{i:03d}", p, f"p{p}", f"t{p}", dt.date(2025, 1, 1) + dt.timedelta(days=10 * p), *rng.sample(subjects, 2), rng.choice([0, 1, 3]), 3, rng.choice([1, 2]))
            for i, p in enumerate(sorted([1] * 20 + [2] * 150 + [3] * 5))]
    df = spark.createDataFrame(rows, ROUND)
    run = GL.run_season(df, contested(spark, []), members_of(spark, df))
    early = df.where("period_seq <= 2")
    state = GL.run_season(early, contested(spark, []), members_of(spark, early)).state.collect()
    known = [r for r in state if r.rounds >= 5]
    assert len(known) > 20
    day, ratings = max(r.as_of for r in state), np.array([r.rating for r in known])
    now = [min(350.0, 173.7178 * math.sqrt((r.deviation / 173.7178) ** 2 + r.volatility ** 2 * (day - r.last_date).days / 7)) for r in known]
    tau = math.sqrt(max(ratings.var() - np.mean(np.square(now)), ratings.var() * 0.05))
    spreads = {r.period_seq: r.tau for r in run.spreads.collect()}
    assert spreads[2] == 150.0 and abs(spreads[3] - tau) < 1e-6
    at = {(r.period_seq, r.subject): (r.rating, r.now_deviation) for r in run.entering.collect()}
    for shrink in (False, True):
        got = {r.section_id: r.p_a for r in GL.predict_rounds(df, run, shrink).collect()}
        assert len(got) == len(rows)
        for r in rows:
            t = spreads.get(r[2], 150.0)
            (x, dx), (y, dy) = at[r[2], r[6]], at[r[2], r[7]]
            x, y = ((1500 + (v - 1500) * t * t / (t * t + d * d) if shrink else v) for v, d in ((x, dx), (y, dy)))
            g = 1 / math.sqrt(1 + 3 * (dx * dx + dy * dy) / 173.7178 ** 2 / math.pi ** 2)
            assert abs(got[r[1]] - 1 / (1 + math.exp(-g * (x - y) / 173.7178))) < 1e-9
