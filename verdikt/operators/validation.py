"""Walk-forward validation of ratings against simpler models."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from verdikt.functions.rules import WEIGHTS
from verdikt.operators.bradley_terry import GRADIENT, Lane, bt_log_odds, bt_rounds, fit_lanes
from verdikt.operators.glicko import Options, VALIDATED, ballot_score, run_season, with_options
from verdikt.operators.lineage import cut_lineage, shared_root
from verdikt.operators.ranking import sequence_number

# Confidence buckets, the swept settings, and the evidence gate.
BUCKETS = ((0.5, 0.55), (0.55, 0.6), (0.6, 0.65), (0.65, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.01))
PAIRING_SWEEP = (60.0, 90.0, 120.0, 180.0, 250.0)
LAMBDA_SWEEP = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
K_SWEEP = (8.0, 16.0, 24.0, 32.0, 48.0, 64.0)
GATE_ROUNDS = 10
DRAWS = 2000
WIN_RATE_PRIOR = 4
#: Rounds that one task plays in their order at most; it holds them and what it hands on.
ELO_ROUNDS = 100_000


def a_won() -> Column:
    return (2 * F.col("won_a") > F.col("ballots")).cast("int")


def side_feature() -> Column:
    return F.when(F.col("side_a") == 1, 1.0).otherwise(-1.0)


def outcome_probability(p_a: str = "p_a") -> Column:
    """Probability given to what happened."""
    return F.when(a_won() == 1, F.col(p_a)).otherwise(1 - F.col(p_a))


def _hit(p: Column) -> Column:
    return F.when(p > 0.5, 1.0).when(p == 0.5, 0.5).otherwise(0.0)


def _surprise(p: Column) -> Column:
    return -F.ln(F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), p)))


def prediction_metrics(preds: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Accuracy, log loss and Brier score of the probability given to what happened."""
    q = F.col(p)
    return preds.groupBy(*keys).agg(
        F.count("*").cast("int").alias("n"), F.avg(_hit(q)).alias("accuracy"),
        F.avg(_surprise(q)).alias("log_loss"), F.avg((1 - q) * (1 - q)).alias("brier"))


def fit_logistics(rows: DataFrame, features: list[str], keys: list[str], target: str = "y") -> dict[tuple, list[float]]:
    """A logistic fit for each value of ``keys``, constant first.

    All fits take their Newton steps together: one aggregate gives every fit's gradient and curvature, a row each, and
    the small solves are local. Values of ``keys`` are few (seasons, variants). A fit with fewer than ten rows per
    coefficient keeps every coefficient at zero.
    """
    k, spark = len(features) + 1, rows.sparkSession
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    rows = cut_lineage(rows.select(*keys, *features, F.col(target).cast("double").alias("_y")))
    counts = {tuple(r[c] for c in keys): r._n for r in rows.groupBy(*keys).agg(F.count("*").alias("_n")).collect()}
    betas = {key: np.zeros(k) for key in counts}
    open_fits = {key for key, n in counts.items() if n >= k * 10}
    numbers = {key: i for i, key in enumerate(sorted(counts, key=repr))}
    types = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys)
    if keys and numbers:
        numbered = spark.createDataFrame([(*key, i) for key, i in numbers.items()], f"{types}_fit int")
        on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]
        rows = rows.alias("l").join(F.broadcast(numbered.alias("r")), reduce(lambda a, b: a & b, on)).select("_fit", *features, "_y")
    else:
        rows = rows.withColumn("_fit", F.lit(0))
    rows = cut_lineage(rows)
    for _ in range(50):
        if not open_fits:
            break
        table = spark.createDataFrame(pa.table([pa.array([numbers[key] for key in open_fits], pa.int32()),
                                                pa.array([betas[key].tolist() for key in open_fits], pa.list_(pa.float64()))], ["_fit", "_beta"]))
        z = reduce(lambda a, b: a + b, [F.col("_beta")[j] * x[j] for j in range(k)])
        w = F.greatest(F.lit(1e-9), F.col("_p") * (1 - F.col("_p")))
        sums = [F.sum((F.col("_y") - F.col("_p")) * x[j]).alias(f"g{j}") for j in range(k)]
        sums += [F.sum(w * x[a] * x[b]).alias(f"h{a}_{b}") for a in range(k) for b in range(a, k)]
        got = {r._fit: r for r in rows.join(F.broadcast(table), "_fit").withColumn("_p", 1 / (1 + F.exp(-z))).groupBy("_fit").agg(*sums).collect()}
        for key in list(open_fits):
            row = got[numbers[key]]
            grad = np.array([row[f"g{j}"] for j in range(k)])
            hess = np.array([[row[f"h{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)])
            try:
                step = np.linalg.solve(hess + 1e-6 * np.eye(k), grad)
            except np.linalg.LinAlgError:
                open_fits.discard(key)
                continue
            betas[key] = betas[key] + step
            if np.abs(step).max() < 1e-9:
                open_fits.discard(key)
    return {key: [float(b) for b in beta] for key, beta in betas.items()}


def fit_logistic(rows: DataFrame, features: list[str], target: str = "y") -> list[float]:
    """One fit over all rows."""
    return fit_logistics(rows, features, [], target).get((), [0.0] * (len(features) + 1))


def with_logistic(rows: DataFrame, features: list[str], keys: list[str], betas: dict[tuple, list[float]]) -> DataFrame:
    """``rows`` with ``p_a`` by the coefficients of their ``keys``; a half where there are none."""
    types = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys)
    table = rows.sparkSession.createDataFrame([(*key, beta) for key, beta in betas.items()], f"{types}_beta array<double>")
    beta = lambda j: F.coalesce(F.col("_beta")[j], F.lit(0.0))
    z = reduce(lambda a, b: a + b, [beta(j + 1) * F.col(f) for j, f in enumerate(features)], beta(0))
    return rows.join(F.broadcast(table), keys, "left").withColumn("p_a", 1 / (1 + F.exp(-z))).drop("_beta")


def fitted(rounds: DataFrame, features: list[str], train: Column, keys: tuple[str, ...] = ("season_id",)) -> DataFrame:
    """Rounds outside ``train`` with ``p_a`` from logistic fits, one for each of ``keys``, on its rounds in ``train``."""
    betas = fit_logistics(rounds.where(train).select(*keys, *features, a_won().alias("y")), features, list(keys))
    return with_logistic(rounds.where(~train), features, list(keys), betas)


def coin_flip(rounds: DataFrame) -> DataFrame:
    return rounds.withColumn("p_a", F.lit(0.5))


def side_only(train: DataFrame, test: DataFrame) -> DataFrame:
    """Rounds of ``test`` with ``p_a`` by the side alone, as each season's ``train`` has it."""
    betas = fit_logistics(train.select("season_id", side_feature().alias("side"), a_won().alias("y")), ["side"], ["season_id"])
    return with_logistic(test.withColumn("side", side_feature()), ["side"], ["season_id"], betas).drop("side")


def _both_sides(rounds: DataFrame) -> DataFrame:
    side = lambda s, w: F.struct(F.col(s).alias("subject"), w.alias("w"))
    return rounds.select("season_id", "period_seq", F.explode(F.array(
        side("a", a_won()), side("b", 1 - a_won()))).alias("s")).select("season_id", "period_seq", "s.*")


def record_before(rounds: DataFrame) -> DataFrame:
    """(season, subject, period): rounds and wins in earlier periods.

    Rounds are summed per period first, so the running window holds one row per
    period of a subject however many rounds it had.
    """
    per = _both_sides(rounds).groupBy("season_id", "subject", "period_seq").agg(
        F.count("*").alias("n"), F.sum("w").alias("w"))
    before = W.partitionBy("season_id", "subject").orderBy("period_seq").rangeBetween(
        W.unboundedPreceding, -1)
    return per.select("season_id", "subject", "period_seq",
                      F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
                      F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"))


def _attach(rounds: DataFrame, table: DataFrame, value: str, names: tuple[str, str],
            default: float) -> DataFrame:
    for side, name in zip("ab", names):
        mine = table.select("season_id", "period_seq", F.col("subject").alias(side), F.col(value).alias(name))
        rounds = rounds.join(mine, ["season_id", "period_seq", side], "left").fillna(default, [name])
    return rounds


def prior_evidence(rounds: DataFrame) -> DataFrame:
    """Adds ``min_rounds``: the fewer rounds either side had before the period."""
    out = _attach(rounds, record_before(rounds), "n_before", ("_na", "_nb"), 0)
    return out.withColumn("min_rounds", F.least("_na", "_nb").cast("int")).drop("_na", "_nb")


def win_rate_to_date(rounds: DataFrame) -> DataFrame:
    """Adds ``rate_gap``: the sides' win rates before the period, pulled toward a half."""
    rate = (F.col("w_before") + WIN_RATE_PRIOR / 2) / (F.col("n_before") + WIN_RATE_PRIOR)
    out = _attach(rounds, record_before(rounds).withColumn("rate", rate), "rate", ("_ra", "_rb"), 0.5)
    return out.withColumn("rate_gap", F.col("_ra") - F.col("_rb")).drop("_ra", "_rb")


def points_by_tournament(results: DataFrame) -> DataFrame:
    """Best entry of a pair at each tournament. results: season_id tournament_id subject points"""
    return results.groupBy("season_id", "tournament_id", "subject").agg(F.max("points").alias("points"))


def points_to_date(rounds: DataFrame, earned: DataFrame, periods: DataFrame) -> DataFrame:
    """Adds ``points_gap``: best-five totals of tournaments finished before the period, over ten.

    A subject's tournaments of one season, one value each, are folded once in
    order; the fold keeps five values.
    """
    done = periods.where("final").select("season_id", "tournament_id", F.col("period_seq").alias("at"))
    gains = points_by_tournament(earned).join(done, ["season_id", "tournament_id"])
    story = gains.groupBy("season_id", "subject").agg(F.array_sort(F.collect_list(F.struct("at", "points"))).alias("h"))
    weights = F.array(*map(F.lit, WEIGHTS))
    total = lambda best: F.round(F.aggregate(F.zip_with(
        best, F.slice(weights, F.lit(1), F.greatest(F.size(best), F.lit(1))),
        lambda p, w: F.coalesce(p, F.lit(0.0)) * w), F.lit(0.0), lambda a, x: a + x), 6)
    start = F.struct(F.array().cast("array<double>").alias("best"),
                     F.array().cast("array<struct<at:int,total:double>>").alias("out"))

    def take(acc: Column, g: Column) -> Column:
        best = F.slice(F.sort_array(F.concat(acc["best"], F.array(g["points"].cast("double"))), False), 1, 5)
        return F.struct(best.alias("best"), F.concat(acc["out"], F.array(F.struct(
            g["at"].cast("int").alias("at"), total(best).alias("total")))).alias("out"))

    told = story.select("season_id", "subject", F.aggregate("h", start, take)["out"].alias("totals"))
    need = _both_sides(rounds).select("season_id", "subject", "period_seq").distinct()
    before = F.filter("totals", lambda t: t["at"] < F.col("period_seq"))
    known = (need.join(told, ["season_id", "subject"]).withColumn("before", before)
             .where(F.size("before") > 0)
             .select("season_id", "subject", "period_seq", F.element_at("before", -1)["total"].alias("total")))
    out = _attach(rounds, known, "total", ("_ta", "_tb"), 0.0)
    return out.withColumn("points_gap", (F.col("_ta") - F.col("_tb")) / 10).drop("_ta", "_tb")


def _elo_seats() -> Column:
    return F.explode(F.array(*[F.struct(F.col(s).alias("subject"), F.lit(s).alias("seat")) for s in "ab"])).alias("s")


def _elo_depths(rounds: DataFrame) -> DataFrame:
    """Seats of ``rounds`` with ``turn`` and ``step``, a period and a depth, numbered through.

    A round's depth among those of its period, the longest chain of rounds that wait for each other and end in it, is found
    for all periods of all seasons at once: a pass carries depths along each subject's rounds and takes the greater of both sides'.
    """
    keys = ["season_id", "section_id"]
    seated = sequence_number(rounds.select(*keys, "period_seq", _elo_seats()).select(*keys, "period_seq", "s.*"),
                             ["season_id", "subject"], "period_seq", [F.asc("section_id")], "turn", descending=False)
    seated = cut_lineage(seated.withColumn("depth", F.lit(1)))
    along = W.partitionBy("season_id", "period_seq", "subject").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    while True:
        carried = seated.withColumn("carried", (F.max(F.col("depth") - F.col("turn")).over(along) + F.col("turn")).cast("int"))
        deeper = carried.groupBy(*keys).agg(F.max("carried").alias("deeper"))
        passed = cut_lineage(carried.join(deeper, keys))
        seated = passed.select(*keys, "period_seq", "subject", "seat", "turn", F.col("deeper").alias("depth"))
        if not passed.where("deeper > depth").take(1):
            break
    depths = {r.period_seq: r.deepest for r in seated.groupBy("period_seq").agg(F.max("depth").alias("deepest")).collect()}
    first, offsets = 0, []
    for period in sorted(depths):
        offsets.append((period, first))
        first += depths[period]
    table = rounds.sparkSession.createDataFrame(offsets, f"period_seq {rounds.schema['period_seq'].dataType.simpleString()}, _first int")
    return seated.join(F.broadcast(table), "period_seq").withColumn("step", (F.col("_first") + F.col("depth")).cast("int")).drop("_first", "depth")


def _elo_stretches(rounds: DataFrame, most: int) -> DataFrame:
    """Seats of ``rounds`` with ``turn`` and ``step``, a stretch of at most ``most`` rounds of a season's order."""
    keys = ["season_id", "section_id"]
    placed = sequence_number(rounds.select(*keys, "period_seq", "a", "b"), ["season_id"], "period_seq", [F.asc("section_id")], "_n", descending=False)
    placed = placed.withColumn("step", F.expr(f"cast((_n - 1) div {most} + 1 as int)"))
    return sequence_number(placed.select(*keys, "period_seq", "step", _elo_seats()).select(*keys, "period_seq", "step", "s.*"),
                           ["season_id", "subject"], "period_seq", [F.asc("section_id")], "turn", descending=False)


def _elo_schedule(rounds: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """``rounds`` with ``step`` and each side's next round: ``next_a seat_a step_a``, ``next_b seat_b step_b``; whether steps are in order.

    Rounds of a period count in section order, and no round of a period waits for a later one. Where a period's rounds are
    many against those of its busiest subject, a step may hold more than ``most`` that do not wait for each other, and steps
    are found by depth. Elsewhere most rounds wait: a step by depth would be smaller than what one task plays in a moment,
    and finding depths takes as many passes as chains are long. There a step is a stretch of the order, played as it stands.
    """
    keys = ["season_id", "section_id"]
    own = rounds.select("season_id", "period_seq", F.explode(F.array("a", "b")).alias("subject")).groupBy("season_id", "period_seq", "subject").count()
    wide = own.groupBy("season_id", "period_seq").agg(F.sum("count").alias("seats"), F.max("count").alias("busiest")).where(F.col("seats") > 2 * most * F.col("busiest"))
    in_order = not wide.take(1)
    seated = cut_lineage(_elo_stretches(rounds, most) if in_order else _elo_depths(rounds))
    after = seated.select("season_id", "subject", (F.col("turn") - 1).alias("turn"), F.col("section_id").alias("next"), F.col("seat").alias("next_seat"),
                          F.col("step").alias("next_step"))
    linked = seated.join(after, ["season_id", "subject", "turn"], "left")
    # Both seats of a round come together once.
    seat = lambda s: F.first(F.when(F.col("seat") == s, F.struct("turn", "next", "next_seat", F.coalesce("next_step", F.lit(0)).alias("at"))), True).alias(s)
    both = linked.groupBy(*keys, "step").agg(seat("a"), seat("b")).select(*keys, "step", *[
        F.col(f"{s}.{c}").alias(f"{n}_{s}") for s in "ab" for c, n in (("turn", "turn"), ("next", "next"), ("next_seat", "seat"), ("at", "step"))])
    return rounds.join(both, keys), in_order


def _play(ks: dict[str, float], last: int, out: pa.Schema):
    """Plays a group's rounds by step; ratings for a round after step ``last`` are letters, all others are handed on here."""
    def run(games: pa.Table, letters: pa.Table) -> pa.Table:
        rating = {(section, seat): elo for section, seat, elo in zip(*(letters[c].to_pylist() for c in ("section_id", "seat", "elo")))}
        rows: list[tuple] = []
        names = ("step", "period_seq", "section_id", "variant", "season_id", "score", *[f"{c}_{s}" for s in "ab" for c in ("next", "seat", "step")])
        for _, _, section, variant, season, score, *onward in sorted(zip(*(games[c].to_pylist() for c in names)), key=lambda g: g[:3]):
            ra, rb = rating.pop((section, "a")), rating.pop((section, "b"))
            gain = ks[variant] * (score - 1 / (1 + 10 ** ((rb - ra) / 400)))
            for by, elo, after, seat, at in (("a", ra + gain, *onward[:3]), ("b", rb - gain, *onward[3:])):
                here = 0 < at <= last
                if here:
                    rating[after, seat] = elo
                if by == "a" or not here:
                    rows.append((variant, season, None if here else after, seat, elo, section, by, ra, rb, gain, 0 if here else at))
        return pa.table(dict(zip(out.names, map(list, zip(*rows)))) if rows else {n: [] for n in out.names}, out)
    return run


def elo(rounds: DataFrame, k: float | dict[str, float], margin_weight: float = 0.0, most: int = ELO_ROUNDS) -> DataFrame:
    """Sequential Elo: every round with both sides' ratings when its turn came, carried through a season.

    Steps are fixed beforehand and rounds are kept by batch. A round that is played posts each side's rating to the batch of
    that side's next round; a batch reads its own rounds and its own post and nothing else, so rows read and written follow
    the rounds. Where steps are depths, rounds of one step do not wait for each other: a step of more than ``most`` rounds is a
    batch of its own and is dealt out by section over as many tasks as it needs, and smaller steps are taken together up to
    ``most`` rounds. Where steps are stretches of the order each is a batch. A season's part of a batch that is not dealt out
    is played in its order by one task, at most ``most`` rounds. With a dict the same rounds run once per named K.
    """
    spark, keys = rounds.sparkSession, ["season_id", "section_id"]
    ks = {n: float(v) for n, v in (k if isinstance(k, dict) else {"elo": k}).items()}
    planned, in_order = _elo_schedule(rounds.select("season_id", F.col("section_id").cast("string").alias("section_id"), "period_seq", "a", "b",
                                                    ballot_score("won_a", "ballots", margin_weight).alias("score")), most)
    games = cut_lineage(planned)
    # A row for each step: as many as the longest chain of rounds that wait, or as stretches of ``most`` rounds.
    sizes = {r.step: r.n for r in games.groupBy("step").agg(F.count("*").alias("n")).collect()}
    batches: list[list[int]] = []
    room = 0
    for step in sorted(sizes):
        if in_order or sizes[step] > room:
            batches.append([])
            room = max(most, sizes[step])
        batches[-1].append(step)
        room -= sizes[step]
    of_step = spark.createDataFrame([(step, n) for n, batch in enumerate(batches, 1) for step in batch], "step int, batch int")
    games = cut_lineage(games.join(F.broadcast(of_step), "step"), "batch")
    starts = F.explode(F.array(*[F.struct(F.lit(s).alias("seat"), F.col(f"turn_{s}").alias("turn")) for s in "ab"])).alias("s")
    none = F.lit(None).cast("double")
    opening = games.select(F.explode(F.array(*map(F.lit, ks))).alias("variant"), *keys, "batch", starts).where("s.turn = 1").select(
        "variant", *keys, F.col("s.seat").alias("seat"), F.lit(1500.0).alias("elo"), F.lit(None).cast("string").alias("played"), F.lit(None).cast("string").alias("by"),
        none.alias("ra"), none.alias("rb"), none.alias("gain"), "batch")
    post = f"{shared_root(spark)}/elo-{uuid.uuid4().hex}"
    opening.write.partitionBy("batch").parquet(post)
    kind = StructType([StructField(f.name, f.dataType) for f in opening.schema if f.name != "batch"])
    sent = StructType([*kind.fields, StructField("step", IntegerType())])
    season = pa.string() if rounds.schema["season_id"].dataType.typeName() == "string" else pa.int64()
    arrow = pa.schema([("variant", pa.string()), ("season_id", season), ("section_id", pa.string()), ("seat", pa.string()), ("elo", pa.float64()), ("played", pa.string()),
                       ("by", pa.string()), ("ra", pa.float64()), ("rb", pa.float64()), ("gain", pa.float64()), ("step", pa.int32())])
    for number, batch in enumerate(batches, 1):
        parts = F.lit(1) if in_order or len(batch) > 1 else F.lit(-(-sizes[batch[0]] // most))
        dealt = lambda df: df.withColumn("_part", F.pmod(F.xxhash64("section_id"), parts).cast("int")).groupBy("season_id", "variant", "_part")
        own = games.where(F.col("batch") == number).drop("batch").withColumn("variant", F.explode(F.array(*map(F.lit, ks))))
        came = spark.read.schema(kind).parquet(f"{post}/batch={number}")
        letters = dealt(own).cogroup(dealt(came)).applyInArrow(_play(ks, batch[-1], arrow), sent)
        (letters.join(F.broadcast(of_step), "step", "left").select(*kind.names, F.coalesce("batch", F.lit(0)).alias("batch"))
         .write.mode("append").partitionBy("batch").parquet(post))
    done = spark.read.schema(StructType([*kind.fields, StructField("batch", IntegerType())])).parquet(post).where("by = 'a'").select("variant", "season_id", F.col("played").alias("section_id"), "ra", "rb", "gain")
    kept = rounds.schema["section_id"].dataType
    return (games.select(*keys, "period_seq", "a", "b", "score").join(done, keys)
            .withColumn("section_id", F.col("section_id").cast(kept)))


def elo_before_period(played: DataFrame, rounds: DataFrame) -> DataFrame:
    """Adds ``elo_gap``: the sides' ratings when the period began, over four hundred."""
    side = lambda s, r: F.struct(F.col(s).alias("subject"), F.col(r).alias("elo"))
    first = played.select("season_id", "variant", "period_seq", "section_id", F.explode(
        F.array(side("a", "ra"), side("b", "rb"))).alias("s")).groupBy(
        "season_id", "variant", "period_seq", "s.subject").agg(F.min_by("s.elo", "section_id").alias("elo"))
    keys = ["season_id", "variant", "period_seq"]
    base = rounds.join(first.select(*keys).distinct(), ["season_id", "period_seq"])
    for s in "ab":
        base = base.join(first.select(*keys, F.col("subject").alias(s), F.col("elo").alias(f"_{s}")), [*keys, s])
    return base.withColumn("elo_gap", (F.col("_a") - F.col("_b")) / 400).drop("_a", "_b")


def walk_forward(rounds: DataFrame, contested: DataFrame, members: DataFrame,
                 options: Options = VALIDATED, variants: dict[str, Options] | None = None,
                 shrink: bool = False) -> DataFrame:
    """Rating predictions of every round from the periods before its own."""
    return run_season(rounds, contested, members, options, variants=variants, predict=True, shrink=shrink).predictions


def shrunk_rating_model(rounds: DataFrame, contested: DataFrame, members: DataFrame,
                        options: Options = VALIDATED) -> DataFrame:
    """As ``walk_forward``, with ratings first pulled to the field by its spread so far."""
    return walk_forward(rounds, contested, members, options, shrink=True)


def bt_models(rounds: DataFrame, unit: str | tuple[str, ...] = "pairs", penalty: float = 1.5, iterations: int = 400,
              first_period: int = 2, gradient: float = GRADIENT) -> DataFrame:
    """Bradley-Terry predictions of each period, refit on everything before it: one lane for each prefix of the periods.

    Several units descend together, told apart by ``unit``.
    """
    units = (unit,) if isinstance(unit, str) else unit
    ready = reduce(DataFrame.unionByName, [bt_rounds(rounds, 1.0, u).withColumn("unit", F.lit(u)) for u in units])
    last = rounds.agg(F.max("period_seq")).first()[0] or 0
    lanes = [Lane(p, penalty, p) for p in range(first_period, max(last, first_period) + 1)]
    strengths, fits = fit_lanes(ready, ["season_id", "unit"], lanes, iterations, gradient)
    scope = ["season_id", "unit", "lane"]
    now = ready.where(F.col("period_seq") >= first_period).withColumn("lane", F.col("period_seq"))
    out = (bt_log_odds(now, strengths, fits, scope)
           .withColumn("p_a", 1 / (1 + F.exp(-F.col("log_odds")))).drop("side_a_ids", "side_b_ids", "lane"))
    return out.drop("unit") if isinstance(unit, str) else out


def sweep_options(side: float | Column, base: Options = Options()) -> dict[str, Options]:
    """Margin x seeding x side, by name."""
    out = {}
    for margin in (0.0, 0.5, 1.0):
        for seeded in (True, False):
            for label, adv in (("side", side), ("no side", 0.0)):
                name = f"margin {margin:g}, {'seeded' if seeded else 'cold'}, {label}"
                out[name] = with_options(base, margin_weight=margin, seed_from_members=seeded, side_advantage=adv)
    return out


def sweep(rounds: DataFrame, contested: DataFrame, members: DataFrame, variants: dict[str, Options],
          dev: Column) -> DataFrame:
    """Metrics of every variant on each season's dev periods, all variants run as one job, best of a season first."""
    preds = walk_forward(rounds, contested, members, variants=variants)
    scored = preds.where(dev).withColumn("p", outcome_probability())
    return prediction_metrics(scored, ["season_id", "variant"]).orderBy("season_id", "log_loss", "variant")


def sweep_grid(rounds: DataFrame, contested: DataFrame, members: DataFrame, side: float | Column,
               dev: Column) -> DataFrame:
    """All of ``sweep_options`` for every season; where a season's best seeds new pairs, that one with every pairing deviation.

    The deviations of all seasons' best variants run as one job.
    """
    variants = sweep_options(side)
    grid = cut_lineage(sweep(rounds, contested, members, variants, dev))
    best = {r.season_id: r.first.variant for r in grid.groupBy("season_id").agg(F.min(F.struct("log_loss", "variant")).alias("first")).collect()}
    seeded = {season: v for season, v in best.items() if variants[v].seed_from_members}
    if seeded:
        name = lambda v, d: f"{v}, pairing RD {d:g}"
        deviations = {name(v, d): with_options(variants[v], pairing_deviation=d) for v in set(seeded.values()) for d in PAIRING_SWEEP}
        theirs = rounds.sparkSession.createDataFrame([(season, name(v, d)) for season, v in seeded.items() for d in PAIRING_SWEEP],
                                                     f"season_id {rounds.schema['season_id'].dataType.simpleString()}, variant string")
        grid = grid.unionByName(sweep(rounds, contested, members, deviations, dev).join(F.broadcast(theirs), ["season_id", "variant"], "left_semi"))
    return grid.orderBy("season_id", "log_loss", "variant")


def sweep_elo(rounds: DataFrame, train: Column, dev: Column, ks: tuple = K_SWEEP) -> DataFrame:
    """Metrics of every K on each season's dev periods; all fits of all seasons step together."""
    gaps = cut_lineage(elo_before_period(elo(rounds, {f"K={k:g}": k for k in ks}), rounds)
                       .withColumn("side", side_feature()))
    scored = fitted(gaps.where(train | dev), ["elo_gap", "side"], train, ("season_id", "variant")).where(dev)
    return (prediction_metrics(scored.withColumn("p", outcome_probability()), ["season_id", "variant"])
            .orderBy("season_id", "log_loss", "variant"))


def sweep_bt(rounds: DataFrame, train: Column, dev: Column, unit: str = "pairs",
             penalties: tuple = LAMBDA_SWEEP, iterations: int = 400) -> DataFrame:
    """Fits every penalty on train in one descent and scores dev, season by season."""
    ready = bt_rounds(rounds, 1.0, unit)
    strengths, fits = fit_lanes(ready.where(train), ["season_id"], [Lane(p, p) for p in penalties], iterations, gradient=1e-5)
    tag = F.explode(F.array(*map(F.lit, penalties))).alias("lane")
    scored = bt_log_odds(ready.where(dev).select("*", tag), strengths, fits, ["season_id", "lane"]).withColumn(
        "p_a", 1 / (1 + F.exp(-F.col("log_odds")))).withColumn("p", outcome_probability())
    return (prediction_metrics(scored.withColumnRenamed("lane", "penalty"), ["season_id", "penalty"])
            .orderBy("season_id", "log_loss", "penalty"))


def calibration(preds: DataFrame, keys: list[str], p: str = "p", buckets: tuple = BUCKETS) -> DataFrame:
    """Per confidence bucket: rounds, stated and actual accuracy."""
    sure = F.greatest(F.col(p), 1 - F.col(p))
    chain = None
    for i, (lo, hi) in enumerate(buckets):
        test = (sure >= lo) & (sure < hi)
        chain = F.when(test, i) if chain is None else chain.when(test, i)
    return (preds.withColumn("bucket", chain).where(F.col("bucket").isNotNull()).groupBy(*keys, "bucket")
            .agg(F.count("*").cast("int").alias("n"), F.avg(sure).alias("said"),
                 F.avg((F.col(p) > 0.5).cast("double")).alias("actual")))


def implied_ceiling(preds: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg(F.greatest(F.col(p), 1 - F.col(p))).alias("implied"))


def paired_bootstrap(pairs: DataFrame, metric: str = "accuracy", draws: int = DRAWS, seed: int = 7) -> DataFrame:
    """``season_id, gap, lo, hi, share_worse, draws``: a season's gap between two models and its 95% interval over resampled rounds.

    pairs: season_id section_id p_one p_two, for the same rounds. A draw weights each round by a Poisson(1) count read off
    a hash of (seed, round, draw), so it does not depend on how rows are spread. A task keeps all draws of its rounds as two
    vectors of sums for each season, and only those move.
    """
    value = (lambda q: _hit(q)) if metric == "accuracy" else (lambda q: _surprise(q))
    gap = value(F.col("p_one")) - value(F.col("p_two"))
    if metric != "accuracy":
        gap = -gap
    # Cumulative Poisson(1) probabilities, as fractions of 53 random bits.
    steps = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, i + 1))) for i in range(12)]) * 2.0 ** 53
    turns = np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            seasons, keys, gaps = batch["season_id"].dictionary_encode(), batch["key"].to_numpy().view(np.uint64), batch["gap"].to_numpy()
            which = seasons.indices.to_numpy()
            for number, season in enumerate(seasons.dictionary.to_pylist()):
                own = np.flatnonzero(which == number)
                weight, total = sums.setdefault(season, np.zeros((2, draws)))
                for at in range(0, len(own), 256):
                    mixed = keys[own[at:at + 256], None] + turns
                    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    counts = np.searchsorted(steps, ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)).astype(np.float64), "right")
                    weight += counts.sum(axis=0)
                    total += gaps[own[at:at + 256]] @ counts
        for season, (weight, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([season] * draws), pa.array(np.arange(draws)), pa.array(weight), pa.array(total)],
                                             ["season_id", "draw", "weight", "total"])

    season = F.col("season_id").cast("string").alias("season_id")
    rows = pairs.select(season, F.xxhash64(F.lit(seed), "section_id").alias("key"), gap.cast("double").alias("gap")).where("gap IS NOT NULL AND season_id IS NOT NULL")
    rows = cut_lineage(rows)
    per_draw = (rows.mapInArrow(tally, "season_id string, draw long, weight double, total double").groupBy("season_id", "draw")
                .agg((F.sum("total") / F.nullif(F.sum("weight"), F.lit(0.0))).alias("diff")))
    q = F.percentile("diff", F.array(F.lit(0.025), F.lit(0.975)))
    spread = per_draw.groupBy("season_id").agg(q[0].alias("lo"), q[1].alias("hi"), F.avg((F.col("diff") <= 0).cast("double")).alias("share_worse"),
                                               F.count("*").cast("int").alias("draws"))
    return rows.groupBy("season_id").agg(F.avg("gap").alias("gap")).join(spread, "season_id")


def held_out_report(preds: DataFrame, keys: list[str], gate: int = GATE_ROUNDS) -> DataFrame:
    """Metrics over all rounds, both sides well known, either not, and eliminations only.

    preds: keys p min_rounds kind
    """
    slices = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("min_rounds") >= gate, "both known").otherwise("either new"),
        F.when(F.col("kind") == "elim", "elims")))
    return prediction_metrics(preds.withColumn("slice", F.explode(slices)), [*keys, "slice"])


def predict_tournaments(preds: DataFrame, points: DataFrame, names: Column) -> DataFrame:
    """Rounds at chosen tournaments with the rating's and the points' call.

    preds: season_id section_id p_a won_a ballots kind min_rounds tournament_id;
    points: season_id section_id points_gap.
    """
    won = a_won() == 1
    call = F.when(F.col("points_gap") == 0, 0.5).when((F.col("points_gap") > 0) == won, 1.0).otherwise(0.0)
    return (preds.where(names).join(points.select("season_id", "section_id", "points_gap"), ["season_id", "section_id"])
            .withColumn("p", outcome_probability())
            .withColumn("favourite", F.greatest("p_a", 1 - F.col("p_a"))).withColumn("points_call", call))
