"""Season-versioned rule values and the scoring expressions that read them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from verdikt.functions.labels import STAGE_ORDER
from verdikt.functions.text import col

# Points by elimination level and adjusted field size. A level
# that a field of that size cannot reach is null, which is not zero points.
# (smallest field, largest field, points in STAGE_ORDER)
ELIM_POINTS = (
    (10, 11, (None, None, None, 3, 7, 11, 17)),
    (12, 13, (None, None, None, 4, 8, 12, 18)),
    (14, 16, (None, None, None, 5, 9, 13, 19)),
    (17, 19, (None, None, 2, 6, 10, 14, 20)),
    (20, 22, (None, None, 3, 7, 11, 15, 21)),
    (23, 27, (None, None, 4, 8, 12, 16, 22)),
    (28, 32, (None, None, 5, 9, 13, 17, 23)),
    (33, 38, (None, 2, 6, 10, 14, 18, 24)),
    (39, 45, (None, 3, 7, 11, 15, 19, 25)),
    (46, 54, (None, 4, 8, 12, 16, 20, 26)),
    (55, 64, (None, 5, 9, 13, 17, 21, 27)),
    (65, 77, (2, 6, 10, 14, 18, 22, 28)),
    (78, 91, (3, 7, 11, 15, 19, 23, 29)),
    (92, 109, (4, 8, 12, 16, 20, 24, 30)),
    (110, 129, (5, 9, 13, 17, 21, 25, 31)),
    (130, 154, (6, 10, 14, 18, 22, 26, 32)),
    (155, 183, (7, 11, 15, 19, 23, 27, 33)),
    (184, 218, (8, 12, 16, 20, 24, 28, 34)),
    (219, None, (9, 13, 17, 21, 25, 29, 35)),
)
# Points of a preliminary record that did not break.
PRELIM_POINTS = {"2-1": 4, "3-0": 8, "3-1": 7, "4-0": 11, "3-2": 4, "4-1": 10, "5-0": 14,
                 "4-2": 6, "5-1": 12, "6-0": 16}
# Points of a member-league record, and how many rounds of it count.
LEAGUE_POINTS = {"2-1": 2, "3-0": 5, "3-1": 4, "4-0": 9}
LEAGUE_ROUNDS = 4
# Half-open break-percentage bands and their penalty.
BREAK_PENALTIES = ((0.0, 4.8, -6), (4.8, 6.7, -5), (6.7, 9.5, -4), (9.5, 13.5, -3),
                   (13.5, 19.0, -2), (19.0, 26.9, -1))
# Adjustment by number of preliminary rounds; seven or more share one.
PRELIM_COUNT = {3: -6, 4: -3, 5: 0, 6: 1}
PRELIM_COUNT_MOST = 3
# Best-five weights.
WEIGHTS = (1.0, 0.9, 0.6, 0.3, 0.1)
# Undebated same-school rounds.
STOOD_DOWN, WENT_THROUGH, FINAL_CLOSEOUT = 2, -2, -3
# The schedule that pays per ballot.
BALLOT_WON, BREAK_BONUS, ELIM_WIN, CHAMPION_BONUS = 2, 2, 4, 2
# Qualifier outcomes, their points and the entries they need.
QUALIFIER = {"qualifier": (8, 10), "alternate": (4, 20)}
# Bracket size by sections, and the smallest field that reaches a level.
SECTIONS_LEVEL = {32: "tripleOcto", 16: "doubleOcto", 8: "octo", 4: "quarter", 2: "semi", 1: "first"}
MIN_FIELD = {"tripleOcto": 65, "doubleOcto": 33, "octo": 17, "quarter": 0, "semi": 0,
             "second": 0, "first": 0}
# What a tournament needs before its entries are taken as listed.
MIN_SCHOOLS, MIN_TEAMS, MIN_PRELIMS = 5, 10, 3
TEAM_SIZE = 2


@dataclass(frozen=True)
class SeasonRules:
    season: str
    qualify_points: float
    elim_points: tuple = ELIM_POINTS
    prelim_points: tuple = tuple(PRELIM_POINTS.items())
    weights: tuple = WEIGHTS


# The seasons with rules of their own.
SEASONS = (SeasonRules("2025-26", 40.0), SeasonRules("2026-27", 43.0))
DEFAULT = SEASONS[0]


def by_season(season: Column | str | None, part: Callable[[SeasonRules], object],
              build: Callable[[object], Column]) -> Column:
    """``build`` over the rules of the row's season; seasons that agree share one branch."""
    default = build(part(DEFAULT))
    if season is None:
        return default
    out = default
    for rules in SEASONS:
        if part(rules) != part(DEFAULT):
            out = F.when(col(season) == rules.season, build(part(rules))).otherwise(out)
    return out


def rules_for_season(df: DataFrame, season: str = "season_id") -> DataFrame:
    """Adds the qualification line and whether the season fell back to the default rules."""
    known = F.col(season).isin([r.season for r in SEASONS])
    return (df.withColumn("qualify_points", by_season(season, lambda r: r.qualify_points, F.lit))
            .withColumn("rules_fallback", ~F.coalesce(known, F.lit(False))))


def rule_records(spark: SparkSession) -> DataFrame:
    """The record tables as rows, to compare with a published document."""
    rows = [(r.season, "prelim", rec, pts) for r in SEASONS for rec, pts in r.prelim_points]
    rows += [(r.season, "league", rec, pts) for r in SEASONS for rec, pts in LEAGUE_POINTS.items()]
    return spark.createDataFrame(rows, "season_id string, section string, record string, points int")


def _when_chain(branches, otherwise=None) -> Column:
    out = None
    for test, value in branches:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out if otherwise is None else out.otherwise(otherwise)


def _in_band(afs: Column, lo, hi) -> Column:
    return (afs >= lo) if hi is None else afs.between(lo, hi)


def afs_band(afs, season=None) -> Column:
    """The band's name, ``"10-11"`` to ``"219+"``; null below the smallest field."""
    return by_season(season, lambda r: r.elim_points, lambda table: _when_chain(
        [(_in_band(col(afs), lo, hi), f"{lo}+" if hi is None else f"{lo}-{hi}")
         for lo, hi, _ in table]))


def elim_points(afs, level, season=None) -> Column:
    def build(table) -> Column:
        row = _when_chain([(_in_band(col(afs), lo, hi),
                            F.array(*[F.lit(p).cast("int") for p in points]))
                           for lo, hi, points in table])
        return F.get(row, F.array_position(F.array(*map(F.lit, STAGE_ORDER)), col(level))
                     .cast("int") - 1)
    return by_season(season, lambda r: r.elim_points, build)


def elim_level_from_sections(n) -> Column:
    return _when_chain([(col(n) == k, v) for k, v in SECTIONS_LEVEL.items()])


def is_level_reachable(afs, level) -> Column:
    return F.coalesce(_when_chain([(col(level) == k, col(afs) >= v)
                                   for k, v in MIN_FIELD.items()]), F.lit(False))


def _record(wins, losses) -> Column:
    return F.concat(col(wins).cast("int").cast("string"), F.lit("-"),
                    col(losses).cast("int").cast("string"))


def _points_of(table, record: Column) -> Column:
    return F.coalesce(_when_chain([(record == k, v) for k, v in table]), F.lit(0))


def prelim_points(wins, losses, season=None) -> Column:
    return by_season(season, lambda r: r.prelim_points,
                     lambda table: _points_of(table, _record(wins, losses)))


def break_penalty(pct) -> Column:
    return F.coalesce(_when_chain([((col(pct) >= lo) & (col(pct) < hi), p)
                                   for lo, hi, p in BREAK_PENALTIES]), F.lit(0))


def prelim_count_adjustment(n) -> Column:
    return F.coalesce(_when_chain([(col(n) >= 7, PRELIM_COUNT_MOST)]
                                  + [(col(n) == k, v) for k, v in PRELIM_COUNT.items()]), F.lit(0))


def score_entries(df: DataFrame, season: str | None = None) -> DataFrame:
    """One column per component of an entry's points.

    Reads ``wins losses elim_level eligible_team_size walkover_adjustment`` and
    the tournament's ``afs break_pct prelim_count breaking_wins breaking_losses``.
    """
    broke = F.col("elim_level").isNotNull()
    walkover = F.coalesce(F.col("walkover_adjustment"), F.lit(0))
    own = prelim_points("wins", "losses", season)
    base = elim_points("afs", "elim_level", season)
    floor = F.when((F.col("wins") > F.col("losses")) & F.col("breaking_wins").isNotNull(),
                   prelim_points("breaking_wins", "breaking_losses", season))
    lifted = broke & base.isNotNull() & F.coalesce(floor > base, F.lit(False))
    reached = F.when(lifted, floor).otherwise(base)
    prelim_adj = F.when(broke & base.isNotNull(), prelim_count_adjustment("prelim_count")).otherwise(0)
    penalty = F.when(broke & base.isNotNull(), break_penalty("break_pct")).otherwise(0)
    base_points = F.when(~broke, own).otherwise(reached)
    counted_walkover = F.when(broke & base.isNull(), 0).otherwise(walkover)
    total = F.coalesce(base_points + prelim_adj + penalty + counted_walkover, F.lit(0))
    return df.select(
        "*",
        F.greatest(total, F.lit(0)).alias("points"),
        base_points.alias("base_points"),
        prelim_adj.alias("prelim_count_adjustment"),
        penalty.alias("break_penalty"),
        counted_walkover.alias("walkover_applied"),
        F.when(total < 0, "zero").when(lifted, "pointsFloor").otherwise("none").alias("floor_applied"),
        F.when(~F.coalesce(F.col("eligible_team_size"), F.lit(False)), "teamSize").alias("excluded"),
        broke.alias("broke"))


def score_member_league(wins, losses) -> Column:
    """Only the first rounds count, and losses are trimmed before wins."""
    rounds = F.least(col(wins) + col(losses), F.lit(LEAGUE_ROUNDS))
    kept = F.least(col(wins), rounds)
    return _points_of(LEAGUE_POINTS.items(), _record(kept, rounds - kept))


def score_qualifier(outcome, entries, enforce_minimum: bool = True) -> Column:
    hits = []
    for name, (points, least) in QUALIFIER.items():
        value = F.when(col(entries) >= least, points).otherwise(0) if enforce_minimum else F.lit(points)
        hits.append((col(outcome) == name, value))
    return F.coalesce(_when_chain(hits), F.lit(0))


def score_ballot_schedule(df: DataFrame) -> DataFrame:
    """Points of the tournament that pays per ballot; the penalty falls on everyone.

    Reads ``prelim_ballots_won broke elim_wins champion walkover_adjustment break_pct``.
    """
    base = (F.col("prelim_ballots_won") * BALLOT_WON
            + F.when(F.col("broke"), BREAK_BONUS).otherwise(0)
            + F.col("elim_wins") * ELIM_WIN
            + F.when(F.col("champion"), CHAMPION_BONUS).otherwise(0))
    penalty = break_penalty("break_pct")
    total = base + penalty + F.coalesce(F.col("walkover_adjustment"), F.lit(0))
    return df.select("*", F.greatest(total, F.lit(0)).alias("points"), base.alias("base_points"),
                     penalty.alias("break_penalty"),
                     F.when(total < 0, "zero").otherwise("none").alias("floor_applied"))


def team_size_gate(people) -> Column:
    """The reason a result is left out of the totals; its points are kept."""
    return F.when(F.coalesce(col(people), F.lit(0)) != TEAM_SIZE, "teamSize")
