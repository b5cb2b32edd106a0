"""Display words for rounds, results, panels and records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from verdikt.functions.text import col

# Elimination levels, widest first.
STAGE_ORDER = ["tripleOcto", "doubleOcto", "octo", "quarter", "semi", "second", "first"]

# What a level is called on a round, and on the entry that reached it.
ROUND_STAGE = {
    "tripleOcto": "Triple octafinals", "doubleOcto": "Double octafinals", "octo": "Octafinals",
    "quarter": "Quarterfinals", "semi": "Semifinals", "second": "Third place", "first": "Finals",
}
ENTRY_RESULT = {
    "tripleOcto": "Triple-octafinalist", "doubleOcto": "Double-octafinalist",
    "octo": "Octafinalist", "quarter": "Quarterfinalist", "semi": "Semifinalist",
    "second": "Finalist", "first": "Champion",
}


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def stage_index(level: Column | str) -> Column:
    """Zero-based position of a level in the bracket, -1 when unknown."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, STAGE_ORDER)), col(level)),
                      F.lit(0)).cast("int") - 1


def round_label(kind, level, label, consolation=None) -> Column:
    consolation = F.lit(False) if consolation is None else col(consolation)
    kind, level, label = col(kind), col(level), col(label)
    plain = F.when(label.rlike(r"^\d+$"), F.concat(F.lit("Round "), label)).otherwise(label)
    stage = F.coalesce(_lookup(ROUND_STAGE, level), label)
    return F.when((kind != "elim") | level.isNull() | (level == ""), plain).otherwise(
        F.when(consolation, F.concat(stage, F.lit(" (consolation)"))).otherwise(stage))


def entry_result_label(level) -> Column:
    return F.when(F.coalesce(col(level), F.lit("")) != "",
                  F.coalesce(_lookup(ENTRY_RESULT, col(level)), col(level)))


def round_outcome(won, ballots, bye) -> Column:
    won, ballots = col(won), col(ballots)
    return (F.when(col(bye), "Bye").when(ballots == 0, "—")
            .when(won * 2 > ballots, "Win").when(won * 2 < ballots, "Loss").otherwise("Split"))


def panel_label(won, ballots) -> Column:
    won, ballots = col(won), col(ballots)
    return F.when(ballots > 1, F.format_string("%d–%d", won, ballots - won))


def side_label(side) -> Column:
    return F.when(col(side) == 1, "Prop").when(col(side) == 2, "Opp")


def record_label(wins, losses, ties) -> Column:
    short = F.format_string("%d–%d", col(wins), col(losses))
    return F.when(col(ties) > 0, F.concat(short, F.lit("–"), col(ties).cast("string"))).otherwise(short)


def walkover_direction(bye, kind, level, category, mine, theirs, ballots, panel, reached) -> Column:
    """Who went through an undebated same-school round: advanced, conceded or unknown."""
    here, got = stage_index(level), stage_index(reached)
    qualifier = F.coalesce(col(category).isin("CHSSA", "OSAA"), F.lit(False))
    same = F.coalesce((col(mine) == col(theirs)) & (col(mine) != ""), F.lit(False))
    short = F.coalesce(col(ballots) < col(panel), F.lit(False))
    applies = ~col(bye) & (col(kind) == "elim") & ~qualifier & same & short
    return F.when(applies, F.when((here < 0) | (got < 0), "unknown")
                  .when(got > here, "advanced").otherwise("conceded"))
