"""Glicko-2 over rating periods (Glickman, 2013), every season and variant at once.

A period is one DataFrame step: ratings before it, one pass over its rounds
summing each subject's evidence, and the state after it. Opponents are summed
by partial aggregates, so a subject with a third of the rounds is summed where
its rounds lie. Only the short loop over periods is sequential.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from verdikt.operators.lineage import cut_lineage

# The system's scale, defaults and stopping tolerance.
SCALE = 173.7178
RATING, DEVIATION, VOLATILITY = 1500.0, 350.0, 0.06
TOLERANCE = 0.000001
MIN_RATED_ROUNDS, MIN_CALIBRATION_ROUNDS = 5, 10
#: The field's spread before enough subjects tell it.
SPREAD = 150.0
PI2 = 9.869604401089358


@dataclass(frozen=True)
class Options:
    tau: float = 0.4
    margin_weight: float = 0.0
    side_advantage: float | Column = 0.0
    seed_from_members: bool = True
    pairing_deviation: float = 120.0
    max_deviation: float = DEVIATION
    weeks_per_decay_period: float = 1.0
    iteration_deviation: float = 250.0


VALIDATED = Options(margin_weight=1.0, pairing_deviation=180.0)


def _g(phi: Column) -> Column:
    return 1 / F.sqrt(1 + 3 * phi * phi / PI2)


def ballot_score(won, total, weight) -> Column:
    """1 or 0 for a decision, pulled toward a draw by ``weight`` as the panel splits."""
    won, total = F.col(won) if isinstance(won, str) else won, F.col(total) if isinstance(total, str) else total
    weight = F.lit(weight) if not isinstance(weight, Column) else weight
    margin = (2 * won - total) / total
    decisive = F.when(margin > 0, 1.0).when(margin < 0, 0.0).otherwise(0.5)
    return F.when(total <= 0, 0.5).otherwise(decisive + weight * (0.5 + margin / 2 - decisive))


def decayed(deviation: Column, volatility: Column, periods: Column, most: float = DEVIATION) -> Column:
    phi = deviation / SCALE
    grown = F.sqrt(phi * phi + volatility * volatility * F.greatest(F.lit(0.0), periods)) * SCALE
    return F.least(F.lit(most), grown)


def weeks_between(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(F.datediff(end, start) / 7.0, F.lit(0.0)))


def deviation_at(deviation: Column, volatility: Column, last: Column, date: Column, o: Options) -> Column:
    weeks = weeks_between(last, date)
    return F.when(weeks <= 0, deviation).otherwise(
        decayed(deviation, volatility, weeks / o.weeks_per_decay_period, o.max_deviation))


def win_probability(r_a, d_a, r_b, d_b, advantage=0.0) -> Column:
    phi = F.sqrt(d_a * d_a + d_b * d_b) / SCALE
    return 1 / (1 + F.exp(-_g(phi) * (r_a + advantage - r_b) / SCALE))


def new_volatility(phi2v: str, delta2: str, sigma: str, tau: float) -> Column:
    """Illinois root find over named columns: sixty folded steps that hold still once converged."""
    a = f"ln({sigma} * {sigma})"

    def f(x: str) -> str:
        d = f"({phi2v} + exp({x}))"
        return f"(exp({x}) * ({delta2} - {d}) / (2 * {d} * {d}) - ({x} - {a}) / {tau * tau})"

    lower = (f"if({delta2} > {phi2v}, ln(greatest({delta2} - {phi2v}, 1e-300)), {a} - {tau} * "
             f"element_at(filter(sequence(1, 200), k -> {f(f'({a} - k * {tau})')} >= 0), 1))")
    step = (f"transform(array(s.a + (s.a - s.b) * s.fa / (s.fb - s.fa)), c -> "
            f"transform(array({f('c')}), fc -> named_struct("
            f"'a', if(fc * s.fb <= 0, s.b, s.a), 'b', c, "
            f"'fa', if(fc * s.fb <= 0, s.fb, s.fa / 2), 'fb', fc))[0])[0]")
    return F.expr(
        f"transform(array({lower}), b0 -> aggregate(sequence(1, 60), "
        f"named_struct('a', {a}, 'b', b0, 'fa', {f(a)}, 'fb', {f('b0')}), "
        f"(s, i) -> if(abs(s.b - s.a) <= {TOLERANCE}, s, {step}), s -> exp(s.a / 2)))[0]")


def glicko_update(df: DataFrame, o: Options) -> DataFrame:
    """New rating from ``rating deviation volatility`` and the summed ``v_inv delta_sum``.

    Without evidence the deviation grows by one period instead.
    """
    phi = F.col("deviation") / SCALE
    seen = F.coalesce(F.col("v_inv") > 0, F.lit(False))
    keep = [c for c in df.columns if c not in ("rating", "deviation", "volatility", "v_inv", "delta_sum")]
    ready = df.select("*", (phi * phi + 1 / F.col("v_inv")).alias("_phi2v"),
                      F.pow(F.col("delta_sum") / F.col("v_inv"), F.lit(2.0)).alias("_delta2"))
    moved = ready.select("*", F.when(seen, new_volatility("_phi2v", "_delta2", "volatility", o.tau)).alias("_sigma"))
    spread = moved.select("*", (1 / F.sqrt(1 / (phi * phi + F.col("_sigma") * F.col("_sigma")) + F.col("v_inv")))
                          .alias("_phi_new"))
    mu = (F.col("rating") - RATING) / SCALE + F.col("_phi_new") * F.col("_phi_new") * F.col("delta_sum")
    return spread.select(
        *keep, F.when(seen, mu * SCALE + RATING).otherwise(F.col("rating")).alias("rating"),
        F.when(seen, F.least(F.lit(o.max_deviation), F.col("_phi_new") * SCALE))
        .otherwise(decayed(F.col("deviation"), F.col("volatility"), F.lit(1.0), o.max_deviation)).alias("deviation"),
        F.coalesce("_sigma", "volatility").alias("volatility"))


def evidence(pairs: DataFrame) -> DataFrame:
    """Adds each opponent's information ``info`` and surprise ``pull`` for the subject.

    Reads rating, their_rating, their_deviation, score, advantage.
    """
    g = _g(F.col("their_deviation") / SCALE)
    edge = (F.col("rating") + F.col("advantage") - F.col("their_rating")) / SCALE
    held = pairs.select("*", g.alias("_g"), (1 / (1 + F.exp(-g * edge))).alias("_e"))
    return held.select(*pairs.columns, (F.col("_g") * F.col("_g") * F.col("_e") * (1 - F.col("_e"))).alias("info"),
                       (F.col("_g") * (F.col("score") - F.col("_e"))).alias("pull"))


def debater_estimates(state: DataFrame, members: DataFrame, scope: list[str], o: Options = VALIDATED) -> DataFrame:
    """Precision-weighted mean of a person's rated partnerships, decayed to ``prev_date``.

    members: scope subject debater_id prev_date, the people asked about.
    """
    dev = deviation_at(F.col("deviation"), F.col("volatility"), F.col("last_date"), F.col("prev_date"), o)
    rated = state.where(F.col("periods") > 0).select(*scope, "subject", "rating", "deviation", "volatility", "last_date")
    w = 1 / (F.col("_dev") * F.col("_dev"))
    return (members.join(rated, [*scope, "subject"]).withColumn("_dev", dev).groupBy(*scope, "debater_id")
            .agg((F.sum(w * F.col("rating")) / F.sum(w)).alias("m_rating"),
                 F.least(F.lit(o.max_deviation), F.sqrt(1 / F.sum(w))).alias("m_deviation"),
                 F.avg("volatility").alias("m_volatility")))


def seed_new_pairs(fresh: DataFrame, estimates: DataFrame, scope: list[str], o: Options = VALIDATED,
                   variants: dict[str, Options] | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Starting rating of subjects without one: a carried-over rating, else from the members.

    fresh: scope subject debater_id, a row per member.
    """
    pairing, seeded = _option(variants, o, "pairing_deviation"), _option(variants, o, "seed_from_members")
    per = (fresh.join(estimates, [*scope, "debater_id"], "left").groupBy(*scope, "subject")
           .agg(F.count("m_rating").alias("known"), F.avg(F.coalesce("m_rating", F.lit(RATING))).alias("mean"),
                (F.sqrt(F.sum(F.pow(F.coalesce("m_deviation", F.lit(DEVIATION)), F.lit(2.0))))
                 / F.count("*")).alias("blur"),
                F.min("m_deviation").alias("least"), F.avg("m_volatility").alias("vol")))
    usable = (F.col("known") > 0) & seeded
    spread = F.least(F.lit(o.max_deviation), F.hypot(F.greatest("blur", "least"), pairing.cast("double")))
    rating = F.when(usable, F.col("mean")).otherwise(RATING)
    deviation = F.when(usable, spread).otherwise(DEVIATION)
    volatility = F.when(usable, F.col("vol")).otherwise(VOLATILITY)
    if initial is not None:
        per = per.join(initial.select(*scope, "subject", F.col("rating").alias("i_r"),
                                      F.col("deviation").alias("i_d"), F.col("volatility").alias("i_v")),
                       [*scope, "subject"], "left")
        carried = F.col("i_r").isNotNull()
        rating = F.when(carried, F.col("i_r")).otherwise(rating)
        deviation = F.when(carried, F.least(F.lit(o.max_deviation), F.greatest(
            F.col("i_d"), F.lit(o.iteration_deviation)))).otherwise(deviation)
        volatility = F.when(carried, F.col("i_v")).otherwise(volatility)
    return per.select(*scope, "subject", rating.alias("seed_rating"), deviation.alias("seed_deviation"),
                      volatility.alias("seed_volatility"))


def _option(variants: dict[str, Options] | None, o: Options, name: str) -> Column:
    if not variants:
        value = getattr(o, name)
        return value if isinstance(value, Column) else F.lit(value)
    out = None
    for variant, opts in variants.items():
        test, value = F.col("variant") == variant, getattr(opts, name)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


@dataclass
class Run:
    state: DataFrame
    history: DataFrame
    predictions: DataFrame | None = None
    scope: list[str] = field(default_factory=list)
    #: What every subject entered each period with, and the field's spread by then.
    entering: DataFrame | None = None
    spreads: DataFrame | None = None


_STATE = ("rating double, deviation double, volatility double, rounds int, contested int, "
          "periods int, last_date date, scheduled boolean, period_id string, tournament_id string, as_of date")


def _empty_state(rounds: DataFrame, scope: list[str]) -> DataFrame:
    spark = rounds.sparkSession
    keys = ", ".join(f"{c} {rounds.schema[c].dataType.simpleString()}" for c in scope)
    return spark.createDataFrame([], f"{keys}, subject string, {_STATE}")


@dataclass
class Schedule:
    """What each period needs that no rating decides, made once for the whole run.

    sides: both views of every rated round; active: every subject of a period with its
    contested rounds; newcomers: the members of subjects met for the first time, with
    the date their estimates were last refreshed. All partitioned by ``period_seq``.
    """

    sides: DataFrame
    active: DataFrame
    newcomers: DataFrame
    periods: int
    with_newcomers: frozenset


def schedule(rounds: DataFrame, contested: DataFrame, members: DataFrame, scope: list[str]) -> Schedule:
    """rounds carry ``score`` and ``adv``, both as side a sees them."""
    view = lambda me, you, score, adv: F.struct(
        F.col(me).alias("subject"), F.col(you).alias("other"), score.alias("score"), adv.alias("advantage"))
    stamp = ["period_seq", "period_id", "tournament_id", "date"]
    sides = cut_lineage(rounds.select(*scope, *stamp, "section_id", F.explode(F.array(
        view("a", "b", F.col("score"), F.col("adv")), view("b", "a", 1 - F.col("score"), -F.col("adv")))).alias("s"))
        .select(*scope, *stamp, "section_id", "s.*"), "period_seq")
    active = (sides.select(*scope, *stamp, "subject", F.lit(0).alias("c"))
              .unionByName(contested.select(*scope, *stamp, "subject", F.col("contested").cast("int").alias("c")))
              .groupBy(*scope, *stamp, "subject").agg(F.sum("c").cast("int").alias("c")))
    active = cut_lineage(active, "period_seq")
    # One short row per period of a run: when it was, and when the one before it was.
    before = W.partitionBy(*scope).orderBy("period_seq")
    calendar = (active.select(*scope, "period_seq", "date").distinct()
                .withColumn("prev_date", F.lag("date").over(before)))
    first = (active.groupBy(*scope, "subject").agg(F.min("period_seq").alias("period_seq"))
             .join(calendar.drop("date"), [*scope, "period_seq"]))
    newcomers = cut_lineage(first.join(members.select(*scope, "subject", "debater_id"), [*scope, "subject"], "left"),
                            "period_seq")
    counts = newcomers.select("period_seq").distinct().collect()  # one value per period
    last = active.agg(F.max("period_seq")).first()[0] or 0
    return Schedule(sides, active, newcomers, last, frozenset(r[0] for r in counts))


def run_period(state: DataFrame, plan: Schedule, seq: int, members: DataFrame, scope: list[str], o: Options,
               variants: dict[str, Options] | None = None, initial: DataFrame | None = None):
    """Steps every run of ``scope`` through one period: (ratings before it, state after it)."""
    subject = [*scope, "subject"]
    active = plan.active.where(F.col("period_seq") == seq).drop("period_seq")
    met = active.join(state.select(*subject, "rating", "deviation", "volatility", "rounds", "contested", "periods",
                                   "last_date"), subject, "left")
    now = deviation_at(F.col("deviation"), F.col("volatility"), F.col("last_date"), F.col("date"), o)
    if seq in plan.with_newcomers:
        fresh = plan.newcomers.where(F.col("period_seq") == seq).drop("period_seq")
        people = fresh.where(F.col("debater_id").isNotNull()).select(*scope, "debater_id", "prev_date").distinct()
        estimates = debater_estimates(state, members.join(people, [*scope, "debater_id"]), scope, o)
        seeds = seed_new_pairs(fresh, estimates, scope, o, variants, initial)
        met = met.join(seeds, subject, "left").withColumns({
            "rating": F.coalesce("rating", "seed_rating"), "deviation": F.coalesce("deviation", "seed_deviation"),
            "volatility": F.coalesce("volatility", "seed_volatility")}).drop(
            "seed_rating", "seed_deviation", "seed_volatility")
    before = cut_lineage(met.withColumn("now_deviation", now))
    mine = before.select(*subject, "rating", F.col("now_deviation").alias("deviation"))
    theirs = mine.select(*scope, F.col("subject").alias("other"), F.col("rating").alias("their_rating"),
                         F.col("deviation").alias("their_deviation"))
    faced = (plan.sides.where(F.col("period_seq") == seq).select(*scope, "subject", "other", "score", "advantage")
             .join(mine, subject).join(theirs, [*scope, "other"]))
    summed = evidence(faced).groupBy(*subject).agg(
        F.sum("info").alias("v_inv"), F.sum("pull").alias("delta_sum"), F.count("*").cast("int").alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    seen = before.join(summed, subject, "left").withColumns({
        "scheduled": F.col("n").isNotNull(), "held": F.col("deviation"), "deviation": F.col("now_deviation"),
        "held_rating": F.col("rating"), "held_volatility": F.col("volatility")})
    went = F.col("scheduled")
    stepped = glicko_update(seen, o).select(
        *subject, F.when(went, F.col("rating")).otherwise(F.col("held_rating")).alias("rating"),
        F.when(went, F.col("deviation")).otherwise(F.col("held")).alias("deviation"),
        F.when(went, F.col("volatility")).otherwise(F.col("held_volatility")).alias("volatility"),
        (zero("rounds") + zero("n")).cast("int").alias("rounds"), (zero("contested") + zero("c")).cast("int").alias("contested"),
        (zero("periods") + went.cast("int")).cast("int").alias("periods"),
        F.when(went, F.col("date")).otherwise(F.coalesce("last_date", "date")).alias("last_date"),
        "scheduled", "period_id", "tournament_id", F.col("date").alias("as_of"))
    kept = state.join(before.select(*subject), subject, "left_anti").withColumn("scheduled", F.lit(False))
    return before, cut_lineage(stepped.unionByName(kept))


def run_season(rounds: DataFrame, contested: DataFrame, members: DataFrame, options: Options = VALIDATED,
               scope: tuple = ("season_id",), variants: dict[str, Options] | None = None,
               initial: DataFrame | None = None, predict: bool = False, shrink: bool = False) -> Run:
    """Folds the periods in order, all runs of ``scope`` stepping together.

    rounds: season_id section_id period_seq period_id tournament_id date a b won_a
    ballots side_a; contested: season_id period_seq period_id tournament_id date
    subject contested; members: season_id subject debater_id. With ``variants``
    the same rounds are run once per option set, told apart by ``variant``.
    """
    scope = list(scope)
    if variants:
        tag = F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant")
        rounds, contested, members = (d.select("*", tag) for d in (rounds, contested, members))
        scope = [*scope, "variant"]
    side = _option(variants, options, "side_advantage")
    scored = rounds.withColumns({
        "score": ballot_score("won_a", "ballots", _option(variants, options, "margin_weight")),
        "adv": F.when(F.col("side_a") == 1, side).otherwise(-side).cast("double")})
    members = cut_lineage(members)
    plan = schedule(scored, contested, members, scope)
    state, history, entering, states = cut_lineage(_empty_state(scored, scope)), [], [], []
    for seq in range(1, plan.periods + 1):
        before, state = run_period(state, plan, seq, members, scope, options, variants, initial)
        history.append(state.where("scheduled").withColumn("period_seq", F.lit(seq)))
        entering.append(before.select(*scope, "subject", "rating", "now_deviation", F.lit(seq).alias("period_seq")))
        states.append(state.withColumn("period_seq", F.lit(seq + 1)))
    merge = lambda parts: reduce(DataFrame.unionByName, parts)
    past = merge(history) if history else state.where("scheduled").withColumn("period_seq", F.lit(0))
    run = Run(state, past, None, scope)
    none = state.withColumn("period_seq", F.lit(0))
    run.entering = merge(entering) if entering else none.select(*scope, "subject", "rating", F.col("deviation").alias("now_deviation"), "period_seq")
    run.spreads = _spreads(merge(states) if states else none, scope, options)
    if predict:
        run.predictions = predict_rounds(scored, run, shrink)
    return run


#: Rows of ratings entering the periods up to which they are broadcast to the rounds; above, rounds are joined by shuffles.
ENTERING_ROWS = 150_000


def predict_rounds(rounds: DataFrame, run: Run, shrink: bool = False, o: Options = VALIDATED) -> DataFrame:
    """Every round with its probability for side a, from the ratings both sides entered its period with.

    With ``shrink`` ratings are first pulled to the field by its spread so far. Rounds without ``adv`` get ``o``'s side advantage.
    """
    keys = [*run.scope, "period_seq"]
    if "adv" not in rounds.columns:
        side = o.side_advantage if isinstance(o.side_advantage, Column) else F.lit(o.side_advantage)
        rounds = rounds.withColumn("adv", F.when(F.col("side_a") == 1, side).otherwise(-side).cast("double"))
    entering = run.entering
    sent = F.broadcast if entering.count() <= ENTERING_ROWS else lambda df: df
    out = rounds
    for s in "ab":
        out = out.join(sent(entering.select(*keys, F.col("subject").alias(s), F.col("rating").alias(f"_r_{s}"), F.col("now_deviation").alias(f"_d_{s}"))), [*keys, s])
    r_a, r_b, d_a, d_b = (F.col(c) for c in ("_r_a", "_r_b", "_d_a", "_d_b"))
    if shrink:
        out = out.join(run.spreads.withColumnRenamed("tau", "_tau"), keys, "left").fillna(SPREAD, ["_tau"])
        r_a, r_b = (shrink_to_field(r, d, F.col("_tau")) for r, d in ((r_a, d_a), (r_b, d_b)))
    return out.withColumn("p_a", win_probability(r_a, d_a, r_b, d_b, F.col("adv"))).drop(
        "score", "adv", "_r_a", "_r_b", "_d_a", "_d_b", "_tau")


def _spreads(states: DataFrame, scope: list[str], o: Options) -> DataFrame:
    """scope period_seq tau: the field's spread once more than twenty subjects have five rounds, else what it was.

    states: the states after all periods, each with the period it goes into. A row for each period of a run is left of them.
    """
    keys = [*scope, "period_seq"]
    days = states.groupBy(*keys).agg(F.max("as_of").alias("_day"))
    now = deviation_at(F.col("deviation"), F.col("volatility"), F.col("last_date"), F.col("_day"), o)
    seen = states.where(F.col("rounds") >= 5).join(days, keys).withColumn("deviation", now)
    fresh = field_spread(seen, keys, ["n"]).where("n > 20").select(*keys, F.col("tau").alias("fresh"))
    so_far = W.partitionBy(*scope).orderBy("period_seq")
    return days.select(*keys).join(fresh, keys, "left").select(
        *keys, F.coalesce(F.last("fresh", True).over(so_far), F.lit(SPREAD)).alias("tau"))


def run_season_iterated(rounds: DataFrame, contested: DataFrame, members: DataFrame,
                        options: Options = VALIDATED, passes: int = 3) -> Run:
    """Later passes start every subject from the rating the pass before ended with."""
    run = run_season(rounds, contested, members, options)
    for _ in range(1, passes):
        initial = cut_lineage(standings_at(run.state, run.scope, None, options).select(
            *run.scope, "subject", "rating", "deviation", "volatility"))
        run = run_season(rounds, contested, members, options, initial=initial)
    return run


def standings_at(state: DataFrame, scope: list[str], date: Column | None = None,
                 o: Options = VALIDATED) -> DataFrame:
    """Every subject with its deviation decayed to ``date``, the run's last period by default."""
    day = F.col("as_of") if date is None else date
    if date is None:
        latest = state.groupBy(*scope).agg(F.max("as_of").alias("_day"))
        state, day = state.join(latest, scope), F.col("_day")
    now = deviation_at(F.col("deviation"), F.col("volatility"), F.col("last_date"), day, o)
    return state.withColumn("deviation", now).select(
        *scope, "subject", "rating", "deviation", "volatility", "rounds", "contested", "periods")


def field_spread(ratings: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """How far apart the field really is: the spread of ratings less what their error explains."""
    spread = F.sqrt(F.greatest(F.col("_var") - F.col("_noise"), F.col("_var") * 0.05))
    return (ratings.groupBy(*keys)
            .agg(F.var_pop("rating").alias("_var"),
                 F.avg(F.col("deviation") * F.col("deviation")).alias("_noise"), F.count("*").alias("n"))
            .withColumn("tau", F.when(F.col("n") < 2, DEVIATION).otherwise(spread))
            .select(*keys, "tau", *(extra or [])))


def shrink_to_field(rating: Column, deviation: Column, tau: Column, field_mean: float = RATING) -> Column:
    return field_mean + (rating - field_mean) * (tau * tau) / (tau * tau + deviation * deviation)


def rating_rows(run: Run, o: Options = VALIDATED, least: int = MIN_CALIBRATION_ROUNDS) -> DataFrame:
    """One row per subject per period and a current row without a tournament, as stored."""
    scope = run.scope
    current = standings_at(run.state, scope, None, o).where("rounds >= 1")
    measured = current.where(F.col("rounds") >= least)
    tau = current.select(*scope).distinct().join(field_spread(measured, scope), scope, "left").fillna(
        DEVIATION, ["tau"])
    gate = (F.col("rounds") + F.col("contested")).alias("rounds_counted")
    cols = [*scope, "subject", "tournament_id", "period_id", "rating", "deviation", "volatility", gate]
    both = run.history.select(*cols).unionByName(
        current.withColumn("tournament_id", F.lit(None).cast("string"))
        .withColumn("period_id", F.lit("current")).select(*cols))
    shrunk = shrink_to_field(F.col("rating"), F.col("deviation"), F.col("tau"))
    return both.join(tau, scope).select(
        *scope, "subject", "tournament_id", "period_id", F.round("rating", 2).alias("rating"),
        F.round("deviation", 2).alias("deviation"), F.round("volatility", 6).alias("volatility"),
        F.round(shrunk, 2).alias("shrunk_rating"), "rounds_counted")


def with_options(o: Options, **changes) -> Options:
    return replace(o, **changes)
