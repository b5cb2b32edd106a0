"""Field sizes and bracket reconstruction from ballots.

Grain is (event, entry) or (event, round, section, entry), so one very large
event spreads over many keys. Event-level facts are partial aggregates. The
only things gathered into one row are an event's elimination rounds, whose
number is the depth of a bracket.

Inputs, by column:
  entries   event_id entry_id school_id dropped
  rounds    event_id round_id round_pos name label type is_prelim is_elim
            [section_count: sections the round lists, counted from ballots if absent]
  ballots   event_id round_id section_id entry_id won is_bye [section_pos], each ballot or counted by side: ``cast`` and
            ``decided`` then say how many, and ``won`` how many of them. Ballots that carry is_prelim, is_elim and round_pos
            are not joined with rounds for it.
  published event_id entry_id prelim_wins prelim_ballots rec_wins rec_losses
            rec_rounds seed champion
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from verdikt.functions.rules import (FINAL_CLOSEOUT, MIN_PRELIMS, MIN_SCHOOLS, MIN_TEAMS, STOOD_DOWN,
                                     WENT_THROUGH, elim_level_from_sections)
from verdikt.operators.lineage import cut_lineage

EVENT = ["event_id"]
ENTRY = ["event_id", "entry_id"]
# The level above each level, and the rungs of the ladder.
DEEPER = {"tripleOcto": "doubleOcto", "doubleOcto": "octo", "octo": "quarter",
          "quarter": "semi", "semi": "first"}
RUNG = {"tripleOcto": 0, "doubleOcto": 1, "octo": 2, "quarter": 3, "semi": 4, "first": 5, "second": 5}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _majority(won: Column, decided: Column) -> Column:
    return won * 2 > decided


def _counted(ballots: DataFrame) -> bool:
    return "cast" in ballots.columns


def _tally(ballots: DataFrame) -> tuple[Column, Column, Column]:
    """Aggregates: ballots cast, decided and won."""
    if _counted(ballots):
        return F.sum("cast"), F.sum("decided"), F.sum("won")
    return F.count("*"), F.count("won"), F.count_if("won")


def _scored(ballots: DataFrame) -> Column:
    """Whether a row says who won."""
    return F.col("decided") > 0 if _counted(ballots) else F.col("won").isNotNull()


def with_section_count(rounds: DataFrame, ballots: DataFrame) -> DataFrame:
    if "section_count" in rounds.columns:
        return rounds
    n = (ballots.groupBy("event_id", "round_id", "section_id").agg(F.lit(1).alias("_s"))
         .groupBy("event_id", "round_id").agg(F.sum("_s").cast("int").alias("section_count")))
    return (rounds.join(n, ["event_id", "round_id"], "left")
            .withColumn("section_count", F.coalesce("section_count", F.lit(0))))


def partition_by_label(rounds: DataFrame) -> DataFrame:
    """Per event: do the labels alone say which bracket each elimination round is in?"""
    label = F.trim(F.coalesce("label", F.lit("")))
    varsity, novice = label.rlike("(?i)^v"), label.rlike("(?i)^n")
    return (rounds.where("is_elim").groupBy(*EVENT)
            .agg((F.bool_and(varsity | novice) & F.bool_or(varsity) & F.bool_or(novice))
                 .alias("by_label")))


def partition_elim_rounds(rounds: DataFrame, ballots: DataFrame) -> DataFrame:
    """Elimination rounds with ``bracket`` (main or consolation) and ``elim_order``.

    Rounds are ordered by name where every name in the event is a number, by
    their place in the payload otherwise. Without telling labels, the main
    bracket is the championship and, walking back, every round that shares an
    entry with the rounds kept so far.
    """
    elims = with_section_count(rounds.where("is_elim"), ballots).join(
        partition_by_label(rounds), EVENT)
    per_event = W.partitionBy(*EVENT)
    numeric = F.min(F.coalesce(F.trim("name").rlike(r"^\d*$"), F.lit(False))).over(per_event)
    key = F.when(numeric & ~F.col("by_label"),
                 F.coalesce(F.trim("name").try_cast("double"), F.lit(0.0))).otherwise(0.0)
    elims = elims.withColumn("elim_order", F.row_number().over(
        per_event.orderBy(key, "round_pos", "round_id")))

    # Which rounds share an entry: the distinct sets of rounds entries appear in.
    seen_in = (_elim_ballots(elims, ballots)
               .select(*ENTRY, "round_id").distinct()
               .groupBy(*ENTRY).agg(F.array_sort(F.collect_set("round_id")).alias("together"))
               .select(*EVENT, "together").distinct())
    shares = (seen_in.withColumn("round_id", F.explode("together"))
              .groupBy("event_id", "round_id")
              .agg(F.array_distinct(F.flatten(F.collect_set("together"))).alias("shares")))
    step = F.struct("elim_order", "round_id",
                    F.coalesce("shares", F.array().cast("array<string>")).alias("shares"),
                    F.lower(F.coalesce("type", F.lit(""))).startswith("final").alias("is_final"))
    walk = (elims.join(shares, ["event_id", "round_id"], "left").groupBy(*EVENT)
            .agg(F.reverse(F.array_sort(F.collect_list(step))).alias("steps")))
    finals = F.filter("steps", lambda s: s["is_final"])
    last = F.when(F.size(finals) > 0, F.element_at(finals, 1)).otherwise(F.element_at("steps", 1))
    kept = F.aggregate(
        "steps", F.array(last["round_id"]),
        lambda acc, s: F.when((s["round_id"] != last["round_id"]) & F.arrays_overlap(s["shares"], acc),
                              F.concat(acc, F.array(s["round_id"]))).otherwise(acc))
    walked = walk.select(*EVENT, kept.alias("kept"), F.size("steps").alias("n_elims"))
    main = (F.when(F.col("n_elims") <= 1, True)
            .when(F.col("by_label"), F.trim("label").rlike("(?i)^v"))
            .otherwise(F.array_contains("kept", F.col("round_id"))))
    return (elims.join(walked, EVENT)
            .withColumn("bracket", F.when(main, "main").otherwise("consolation"))
            .drop("kept", "n_elims", "by_label"))


def main_bracket(rounds: DataFrame, ballots: DataFrame) -> DataFrame:
    return partition_elim_rounds(rounds, ballots).where(F.col("bracket") == "main").drop("bracket")


def _elim_ballots(elims: DataFrame, ballots: DataFrame) -> DataFrame:
    known = ballots.where(F.col("entry_id").isNotNull())
    if "is_elim" in ballots.columns:
        return known.where("is_elim")
    return known.join(elims.select("event_id", "round_id"), ["event_id", "round_id"], "left_semi")


def _prelim_ballots(rounds: DataFrame, ballots: DataFrame) -> DataFrame:
    if "is_prelim" in ballots.columns:
        return ballots.where(F.col("entry_id").isNotNull() & F.col("is_prelim"))
    prelims = rounds.where("is_prelim").select("event_id", "round_id", "round_pos")
    return ballots.where(F.col("entry_id").isNotNull()).join(prelims, ["event_id", "round_id"])


def forfeit_exclusion(entries: DataFrame, rounds: DataFrame, ballots: DataFrame) -> DataFrame:
    """Entries with ``forfeited``: dropped, or never scored and never given a bye in a prelim.

    The second test needs some prelim of the event to carry a result.
    """
    seen = (_prelim_ballots(rounds, ballots).groupBy(*ENTRY)
            .agg(F.bool_or(_scored(ballots)).alias("scored"), F.bool_or(_scored(ballots) | F.col("is_bye")).alias("competed")))
    any_scored = seen.groupBy(*EVENT).agg(F.max("scored").alias("any_scored"))
    competed = F.coalesce("competed", F.lit(False))
    return (entries.join(seen, ENTRY, "left").join(any_scored, EVENT, "left")
            .withColumn("forfeited", F.coalesce("dropped", F.lit(False))
                        | (F.coalesce("any_scored", F.lit(False)) & ~competed))
            .drop("scored", "competed", "any_scored"))


def _in_rounds(main: DataFrame, ballots: DataFrame, *cols: str) -> DataFrame:
    known = ballots.where(F.col("entry_id").isNotNull())
    if "is_elim" in ballots.columns:
        known = known.where("is_elim")
    return known.join(main.select("event_id", "round_id", *cols), ["event_id", "round_id"])


def elim_field(main: DataFrame, ballots: DataFrame) -> DataFrame:
    """Per event: entries in the main bracket, byes, and the size its first round implies."""
    sides = _in_rounds(main, ballots).groupBy("event_id", "round_id", "section_id", "entry_id").agg(
        F.bool_or("is_bye").alias("is_bye"))
    seen = sides.select(*ENTRY).distinct().groupBy(*EVENT).agg(
        F.count("*").cast("int").alias("elim_entries"))
    byes = sides.groupBy(*EVENT).agg(F.count_if("is_bye").cast("int").alias("bye_count"))
    first = main.groupBy(*EVENT).agg(
        (F.min_by("section_count", "elim_order") * 2).cast("int").alias("first_elim_bracket"),
        F.max("section_count").alias("widest"))
    return (first.join(seen, EVENT, "left").join(byes, EVENT, "left")
            .fillna(0, ["elim_entries", "bye_count"]))


def recover_absent_breakers(main: DataFrame, ballots: DataFrame, entries: DataFrame, published: DataFrame,
                            perf: DataFrame | None = None, rounds: DataFrame | None = None) -> DataFrame:
    """Per event: entries that broke and then appear in no elimination round.

    Needs an unfilled slot, a seed shallower than the deepest seed present, and
    a record at least as good as the worst that broke; never more than the
    unfilled slots. Without ``perf``, records are told from the prelims of events whose present entries are all seeded
    and leave a slot; no others are read for them.
    """
    seeds = cut_lineage(published.where(F.col("seed").isNotNull()).select(*ENTRY, "seed"))
    slots = main.groupBy(*EVENT).agg((F.max("section_count") * 2).alias("slots"))
    # Only events with a seed can have one; where there is none, nothing is moved.
    seeded = seeds.select(*EVENT).distinct()
    present = cut_lineage(_in_rounds(main.join(seeded, EVENT, "left_semi"), ballots).select(*ENTRY).distinct().join(seeds, ENTRY, "left"))
    open_slots = (present.groupBy(*EVENT).agg(F.count("*").alias("n"), F.count("seed").alias("n_seeded"), F.max("seed").alias("deepest"))
                  .where("n = n_seeded").join(slots, EVENT).withColumn("unfilled", F.col("slots") - F.col("n")).where("unfilled > 0"))
    open_slots = cut_lineage(open_slots.select(*EVENT, "deepest", "unfilled"))
    here = lambda d: d.join(open_slots.select(*EVENT), EVENT, "left_semi")
    unknown = 0 if perf is None else None  # an entry in no list and no prelim has lost and won nothing
    if perf is None:
        perf = apply_published(prelim_record(here(rounds), here(ballots)), here(entries), here(rounds), here(published))
    records = cut_lineage(here(perf.select(*ENTRY, "wins", "losses")))
    known = [F.coalesce(c, F.lit(unknown).cast("int")).alias(c) for c in ("wins", "losses")]
    line = (here(present).join(records, ENTRY, "left").select(*EVENT, *known).where("wins is not null").groupBy(*EVENT)
            .agg(F.min(F.struct("wins", (-F.col("losses")).alias("neg"))).alias("worst")))
    open_slots = open_slots.join(line, EVENT)
    taken = here(present).select(*EVENT, "seed").distinct()
    by_rank = (here(seeds).join(here(entries).select(*ENTRY), ENTRY, "left_semi")
               .groupBy(*EVENT, "seed").agg(F.max("entry_id").alias("entry_id")))
    cleared = ((F.col("wins") > F.col("worst.wins"))
               | ((F.col("wins") == F.col("worst.wins")) & (-F.col("losses") >= F.col("worst.neg"))))
    return (by_rank.join(taken, [*EVENT, "seed"], "left_anti").join(open_slots, EVENT)
            .where((F.col("seed") >= 1) & (F.col("seed") < F.col("deepest")))
            .join(records, ENTRY).where(cleared)
            .groupBy(*EVENT).agg(F.least(F.count("*"), F.max("unfilled")).cast("int").alias("recovered")))


def event_field_stats(entries: DataFrame, rounds: DataFrame, ballots: DataFrame,
                      published: DataFrame, perf: DataFrame | None = None) -> DataFrame:
    """One row per event: raw, forfeited and net field, elimination field, prelims, byes, flags."""
    main = cut_lineage(main_bracket(rounds, ballots))
    sizes = (forfeit_exclusion(entries, rounds, ballots).groupBy(*EVENT)
             .agg(F.count("*").cast("int").alias("raw_entries"),
                  F.count_if("forfeited").cast("int").alias("forfeited_out")))
    shape = rounds.groupBy(*EVENT).agg(F.count_if("is_prelim").cast("int").alias("prelim_count"))
    seen = ballots.groupBy(*EVENT).agg(
        F.count("*").alias("n_ballots"),
        F.bool_or(_scored(ballots) & F.col("entry_id").isNotNull()).alias("any_scored"))
    absent = recover_absent_breakers(main, ballots, entries, published, perf, rounds)
    events = shape.join(sizes, EVENT, "full_outer")
    out = (events.join(seen, EVENT, "left").join(elim_field(main, ballots), EVENT, "left")
           .join(absent, EVENT, "left"))
    zero = ["raw_entries", "forfeited_out", "prelim_count", "bye_count", "elim_entries", "recovered"]
    out = out.fillna(0, zero)
    return out.select(
        *EVENT, "raw_entries", "forfeited_out",
        (F.col("raw_entries") - F.col("forfeited_out")).alias("field_size"),
        (F.col("elim_entries") + F.col("recovered")).alias("elim_field"),
        "first_elim_bracket", "prelim_count", "bye_count",
        ((F.col("raw_entries") == 0) & F.col("n_ballots").isNull()).alias("phantom"),
        (~F.coalesce("any_scored", F.lit(False))).alias("unscored"))


def prelim_record(rounds: DataFrame, ballots: DataFrame) -> DataFrame:
    """Wins and losses by majority of ballots per prelim; a tie is a loss, a bye a win."""
    n, won, scored = F.count("*"), F.count_if(F.coalesce("won", F.col("is_bye"))), F.count("won")
    if _counted(ballots):
        open_bye = F.when(F.col("is_bye"), F.col("cast") - F.col("decided")).otherwise(0)
        n, won, scored = F.sum(F.col("decided") + open_bye), F.sum(F.col("won") + open_bye), F.sum("decided")
    per_round = (_prelim_ballots(rounds, ballots).where(_scored(ballots) | F.col("is_bye"))
                 .groupBy(*ENTRY, "round_id").agg(won.alias("w"), n.alias("n"), scored.alias("scored")))
    return (per_round.groupBy(*ENTRY)
            .agg(F.count_if(_majority(F.col("w"), F.col("n"))).cast("int").alias("wins"),
                 F.count_if(~_majority(F.col("w"), F.col("n"))).cast("int").alias("losses"),
                 F.count("*").cast("int").alias("debated"),
                 F.sum("scored").cast("int").alias("scored_ballots")))


def prelim_record_with_ties(rounds: DataFrame, ballots: DataFrame) -> DataFrame:
    """As shown on a profile: a split panel is a tie, kept apart from losses."""
    n, w = F.col("n"), F.col("w")
    per_round = (_prelim_ballots(rounds, ballots).groupBy(*ENTRY, "round_id")
                 .agg(F.count_if("won").alias("w"), F.count("*").alias("n"),
                      F.bool_or("is_bye").alias("bye")))
    return per_round.groupBy(*ENTRY).agg(
        F.count_if(F.col("bye") | (w * 2 > n)).cast("int").alias("wins"),
        F.count_if(~F.col("bye") & (w * 2 < n)).cast("int").alias("losses"),
        F.count_if(~F.col("bye") & (w * 2 == n)).cast("int").alias("ties"))


def apply_published(record: DataFrame, entries: DataFrame, rounds: DataFrame,
                    published: DataFrame) -> DataFrame:
    """Every entry's record, with the published figures where they take precedence."""
    shape = rounds.groupBy(*EVENT).agg(F.count_if("is_prelim").cast("int").alias("prelim_count"))
    scored = record.groupBy(*EVENT).agg(F.sum("scored_ballots").alias("event_scored"))
    known = entries.select(*ENTRY, F.lit(True).alias("listed"))
    base = (known.join(record, ENTRY, "full_outer")
            .join(published.select(*ENTRY, "prelim_wins", "rec_wins", "rec_losses", "rec_rounds"),
                  ENTRY, "left")
            .join(shape, EVENT, "left").join(scored, EVENT, "left")
            .fillna(0, ["wins", "losses", "debated", "prelim_count", "event_scored"]))
    use_record = (F.col("prelim_count") == 0) | (F.col("event_scored") == 0)
    from_record = use_record & (F.coalesce("rec_rounds", F.lit(0)) > 0)
    wins = (F.when(from_record, F.col("rec_wins"))
            .otherwise(F.coalesce("prelim_wins", "wins")).cast("int"))
    played = F.greatest("debated", "prelim_count")
    losses = (F.when(from_record, F.col("rec_losses"))
              .when(use_record | F.col("listed").isNull(), F.col("losses"))
              .otherwise(F.greatest(F.lit(0), played - wins)).cast("int"))
    return base.select(*ENTRY, wins.alias("wins"), losses.alias("losses"))


def panel_mode(rounds: DataFrame, ballots: DataFrame) -> DataFrame:
    """Per event: the most frequent prelim panel size, the later-seen one on equal frequency."""
    section_pos = F.col("section_pos") if "section_pos" in ballots.columns else F.col("section_id")
    per_section = (_prelim_ballots(rounds, ballots).withColumn("_pos", section_pos)
                   .groupBy("event_id", "round_id", "section_id")
                   .agg(_tally(ballots)[1].alias("scored"),
                        F.count_distinct("entry_id").alias("sides"),
                        F.max(F.struct("round_pos", "_pos")).alias("seen"))
                   .where((F.col("sides") >= 2) & (F.col("scored") > 0)))
    sizes = (per_section.withColumn("panel", F.col("scored") / F.col("sides"))
             .groupBy(*EVENT, "panel").agg(F.count("*").alias("n"), F.max("seen").alias("seen")))
    return sizes.groupBy(*EVENT).agg(F.max_by("panel", F.struct("n", "seen")).alias("panel_size"))


def prelim_ballots(entries: DataFrame, rounds: DataFrame, ballots: DataFrame,
                   published: DataFrame) -> DataFrame:
    """Prelim ballots won and available; a round nobody entered counts at full panel size
    for an entry that competed, unless the tabulators published a count."""
    shape = rounds.groupBy(*EVENT).agg(F.count_if("is_prelim").cast("int").alias("prelim_count"))
    mine = (_prelim_ballots(rounds, ballots).groupBy(*ENTRY, "round_id")
            .agg(_tally(ballots)[1].alias("scored"), _tally(ballots)[2].alias("w"))
            .where("scored > 0").groupBy(*ENTRY)
            .agg(F.sum("scored").alias("scored"), F.sum("w").alias("w"),
                 F.count("*").alias("rounds_scored")))
    out = (entries.select(*ENTRY).join(mine.select(*ENTRY), ENTRY, "full_outer")
           .join(mine, ENTRY, "left")
           .join(published.select(*ENTRY, "prelim_ballots"), ENTRY, "left")
           .join(shape, EVENT, "left").join(panel_mode(rounds, ballots), EVENT, "left")
           .fillna(1.0, ["panel_size"]).fillna(0, ["prelim_count"]))
    credit = (F.col("prelim_count") - F.col("rounds_scored")) * F.col("panel_size")
    said = F.col("prelim_ballots").isNotNull()
    return out.select(
        *ENTRY,
        F.when(said, F.col("prelim_ballots")).otherwise(F.coalesce(F.col("w") + credit, F.lit(0.0)))
        .alias("prelim_ballots_won"),
        F.when(said, F.col("prelim_count") * F.col("panel_size"))
        .otherwise(F.coalesce(F.col("scored") + credit, F.lit(0.0))).alias("prelim_ballots_total"))


def bracket_sides(main: DataFrame, ballots: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per entry per section of the main bracket, with what the later steps read.

    ``depth`` numbers an event's rounds from the fewest sections up, ``ladder``
    from the most down.
    """
    event = W.partitionBy(*EVENT)
    ordered = (main.withColumn("depth", F.row_number().over(event.orderBy("section_count", "elim_order")))
               .withColumn("ladder", F.row_number().over(
                   event.orderBy(F.desc("section_count"), "elim_order")))
               .withColumn("level", elim_level_from_sections("section_count")))
    side = (_in_rounds(ordered, ballots, "section_count", "depth", "ladder", "level")
            .groupBy("event_id", "round_id", "section_id", "entry_id", "section_count", "depth",
                     "ladder", "level")
            .agg(*[n.cast("int").alias(c) for n, c in zip(_tally(ballots), ("panel", "decided", "won"))])
            .join(entries.select(*ENTRY, "school_id"), ENTRY, "left"))
    section = side.groupBy("event_id", "round_id", "section_id").agg(
        F.count("*").cast("int").alias("sides"),
        (F.min("school_id").isNotNull() & (F.min("school_id") == F.max("school_id"))).alias("one_school"),
        (F.sum("decided") == 0).alias("unscored"))
    widest = side.groupBy("event_id", "round_id").agg(F.max("panel").alias("round_panel"))
    return (side.join(section, ["event_id", "round_id", "section_id"])
            .join(widest, ["event_id", "round_id"])
            .withColumn("majority", _majority(F.col("won"), F.col("decided"))))


def elim_depth(sides: DataFrame) -> DataFrame:
    """Deepest level per entry, and whether it won a published final."""
    first = F.min_by(F.struct("level", "majority"), F.struct("depth", "section_id"))
    deepest = (sides.where(F.col("level").isNotNull()).groupBy(*ENTRY)
               .agg(first.alias("at"), F.min("depth").alias("level_depth")))
    is_final = F.col("at.level") == "first"
    return deepest.select(
        *ENTRY, "level_depth",
        F.when(is_final & ~F.col("at.majority"), "second").otherwise(F.col("at.level")).alias("elim_level"),
        (is_final & F.col("at.majority")).alias("won_final"))


def walkover_adjustment(sides: DataFrame, depth: DataFrame) -> DataFrame:
    """Same-school sections that drew a short panel, priced per entry."""
    pair = (F.col("sides") == 2) & F.col("one_school")
    advanced = (F.col("level_depth") < F.col("depth")) | ((F.col("decided") > 0) & F.col("majority"))
    price = (F.when(F.col("level") == "first", FINAL_CLOSEOUT)
             .when(advanced, WENT_THROUGH).otherwise(STOOD_DOWN))
    short = pair & (F.col("panel") < F.col("round_panel"))
    return (sides.where(F.col("level").isNotNull()).join(depth.select(*ENTRY, "level_depth"), ENTRY)
            .groupBy(*ENTRY)
            .agg(F.sum(F.when(short, price).otherwise(0)).cast("int").alias("walkover_adjustment"),
                 F.count_if(pair & F.col("unscored")).cast("int").alias("same_school_walkovers")))


def promote_past_missing_round(sides: DataFrame, depth: DataFrame) -> DataFrame:
    """Lifts an entry that won its deepest round when the next level has no round at all."""
    levels = (sides.where(F.col("level").isNotNull()).groupBy(*EVENT)
              .agg(F.collect_set("level").alias("levels")))
    last_round = sides.groupBy(*ENTRY).agg(F.min("depth").alias("depth"))
    won_last = (sides.join(last_round, [*ENTRY, "depth"], "left_semi").groupBy(*ENTRY)
                .agg(F.bool_or("majority").alias("won_last")))
    up = _map(DEEPER)[F.col("elim_level")]
    lifted = (~F.col("won_final") & F.col("won_last") & up.isNotNull()
              & ~F.array_contains("levels", up))
    lifted = F.coalesce(lifted, F.lit(False))
    return (depth.join(won_last, ENTRY, "left").join(levels, EVENT, "left")
            .select(*ENTRY, "level_depth",
                    F.when(lifted, up).otherwise(F.col("elim_level")).alias("elim_level"),
                    (F.col("won_final") | (lifted & (up == "first"))).alias("won_final"),
                    (lifted & (up == "first")).alias("promoted")))


def unpublished_closeout(promoted: DataFrame, entries: DataFrame) -> DataFrame:
    """Two or more promoted champions of one school share an unplayed final."""
    who = (promoted.where("promoted").select(*ENTRY)
           .join(entries.select(*ENTRY, "school_id"), ENTRY, "left")
           .withColumn("school", F.coalesce("school_id", F.concat(F.lit("?"), "entry_id"))))
    shared = (who.groupBy(*EVENT).agg(F.count("*").alias("n"), F.min("school").alias("lo"),
                                      F.max("school").alias("hi"))
              .where("n >= 2 and lo = hi").select(*EVENT))
    return who.join(shared, EVENT, "left_semi").select(*ENTRY, F.lit(FINAL_CLOSEOUT).alias("closeout"))


def missing_round_walkovers(main: DataFrame, sides: DataFrame) -> DataFrame:
    """Walkovers of a round the bracket skips, applied only where no other pairing was possible."""
    ladder = W.partitionBy(*EVENT).orderBy(F.desc("section_count"), "elim_order")
    steps = (main.withColumn("ladder", F.row_number().over(ladder))
             .withColumn("above", F.lead("section_count").over(ladder))
             .where(F.col("above") * 2 < F.col("section_count")).select(*EVENT, "ladder"))
    winners = (sides.where(F.col("majority") | (F.col("sides") == 1)).join(steps, [*EVENT, "ladder"])
               .select(*ENTRY, "ladder", "school_id"))
    through = (sides.withColumn("ladder", F.col("ladder") - 1).join(steps, [*EVENT, "ladder"], "left_semi")
               .select(*ENTRY, "ladder").distinct().withColumn("through", F.lit(True)))
    both = winners.join(through, [*ENTRY, "ladder"], "full_outer").withColumn(
        "through", F.coalesce("through", F.lit(False)))
    is_winner = winners.select(*ENTRY, "ladder", F.lit(True).alias("winner")).distinct()
    both = both.join(is_winner, [*ENTRY, "ladder"], "left")
    fits = (both.groupBy(*EVENT, "ladder")
            .agg(F.count("winner").alias("n_win"),
                 F.count_distinct(F.when(F.col("through"), F.col("entry_id"))).alias("n_through"),
                 F.count_if(F.col("through") & F.col("winner").isNull()).alias("strangers"),
                 F.count_if(F.col("winner") & F.coalesce("school_id", F.lit("")).eqNullSafe(""))
                 .alias("no_school"))
            .where("n_win = n_through * 2 and strangers = 0"))
    stop = (fits.where("no_school > 0").groupBy(*EVENT).agg(F.min("ladder").alias("stop")))
    open_steps = (fits.join(stop, EVENT, "left")
                  .where(F.col("stop").isNull() | (F.col("ladder") < F.col("stop")))
                  .select(*EVENT, "ladder"))
    settled = both.where("winner").join(open_steps, [*EVENT, "ladder"])
    forced = (settled.groupBy(*EVENT, "ladder", "school_id")
              .agg(F.count("*").alias("n"), F.count_if("through").alias("k"))
              .groupBy(*EVENT, "ladder").agg(F.bool_and((F.col("n") == 2) & (F.col("k") == 1)).alias("ok")).where("ok"))
    return (settled.join(forced, [*EVENT, "ladder"], "left_semi").groupBy(*ENTRY)
            .agg(F.sum(F.when(F.col("through"), WENT_THROUGH).otherwise(STOOD_DOWN)).cast("int")
                 .alias("missing_round")))


def resolve_championship(sides: DataFrame, reached: DataFrame, published: DataFrame) -> DataFrame:
    """A one-section final: published champions decide; an unscored one between schoolmates is
    shared, and between others crowns nobody."""
    champions = published.where("champion").select(*ENTRY, F.lit(True).alias("named"))
    final = (sides.where("depth = 1 and section_count = 1").join(champions, ENTRY, "left"))
    room = final.groupBy(*EVENT).agg(
        F.bool_or(F.coalesce("named", F.lit(False))).alias("any_named"),
        F.first("unscored").alias("unscored"), F.max("sides").alias("n"),
        F.first("one_school").alias("one_school"))
    named = F.coalesce("named", F.lit(False))
    crown = (F.when(F.col("any_named"), named)
             .when(F.col("unscored") & (F.col("n") > 1), F.col("one_school")))
    verdict = (final.select(*ENTRY, "named").join(room, EVENT)
               .select(*ENTRY, crown.alias("crown")).where(F.col("crown").isNotNull()))
    return (reached.join(verdict, ENTRY, "left")
            .withColumn("elim_level", F.when(F.col("crown"), "first").when(~F.col("crown"), "second")
                        .otherwise(F.col("elim_level")))
            .withColumn("won_final", F.coalesce("crown", "won_final")).drop("crown"))


def elim_wins(sides: DataFrame, reached: DataFrame) -> DataFrame:
    """Rungs climbed from the entry's first round, and one more for the champion."""
    start = (sides.where(F.col("level").isNotNull()).groupBy(*ENTRY)
             .agg(F.min(_map(RUNG)[F.col("level")]).alias("from_rung")))
    climbed = (_map(RUNG)[F.col("elim_level")] - F.col("from_rung")
               + F.col("won_final").cast("int"))
    return (reached.join(start, ENTRY, "left")
            .withColumn("elim_wins", F.coalesce(F.greatest(F.lit(0), climbed), F.lit(0)).cast("int"))
            .drop("from_rung"))


def entry_performance(entries: DataFrame, rounds: DataFrame, ballots: DataFrame,
                      published: DataFrame) -> DataFrame:
    """Record, ballots, depth, walkovers and elimination wins of every entry."""
    record = apply_published(prelim_record(rounds, ballots), entries, rounds, published)
    # Read by every step below, so each is computed once and kept as a table.
    main = cut_lineage(main_bracket(rounds, ballots))
    sides = cut_lineage(bracket_sides(main, ballots, entries))
    depth = cut_lineage(elim_depth(sides))
    promoted = cut_lineage(promote_past_missing_round(sides, depth))
    reached = elim_wins(sides, resolve_championship(sides, promoted, published))
    out = (record.join(prelim_ballots(entries, rounds, ballots, published), ENTRY, "left")
           .join(reached.drop("level_depth", "promoted"), ENTRY, "full_outer")
           .join(walkover_adjustment(sides, depth), ENTRY, "left")
           .join(unpublished_closeout(promoted, entries), ENTRY, "left")
           .join(missing_round_walkovers(main, sides), ENTRY, "left"))
    ints = ["wins", "losses", "elim_wins", "walkover_adjustment", "same_school_walkovers", "closeout",
            "missing_round"]
    out = out.fillna(0, ints).fillna(0.0, ["prelim_ballots_won", "prelim_ballots_total"])
    return out.select(
        *ENTRY, "wins", "losses", "prelim_ballots_won", "prelim_ballots_total", "elim_level",
        F.coalesce("won_final", F.lit(False)).alias("won_final"), "elim_wins",
        (F.col("walkover_adjustment") + F.col("closeout") + F.col("missing_round"))
        .alias("walkover_adjustment"),
        "same_school_walkovers")


def lowest_breaking_record(perf: DataFrame, keys: list[str]) -> DataFrame:
    """Fewest wins, then most losses, among entries that broke with a winning record."""
    worst = F.min(F.struct("wins", (-F.col("losses")).alias("neg")))
    return (perf.where(F.col("elim_level").isNotNull() & (F.col("wins") > F.col("losses")))
            .groupBy(*keys).agg(worst.alias("w"))
            .select(*keys, F.col("w.wins").alias("breaking_wins"),
                    (-F.col("w.neg")).cast("int").alias("breaking_losses")))


def tournament_context(events: DataFrame, stats: DataFrame, perf: DataFrame | None,
                       sheet: DataFrame | None = None, fields_from_sheet: bool = True,
                       record_from_sheet: bool = True) -> DataFrame:
    """Field sizes, break percentage and, unless ``perf`` is None, breaking record per tournament.

    ``events`` carries ``tournament_id event_id division is_parli owned in_field``.
    ``sheet`` carries the published ``open_field afs open_elim_field break_pct
    prelim_count breaking_wins breaking_losses``, each used where configured and present.
    """
    live = events.join(stats, EVENT).where(~F.col("phantom"))
    supported = F.col("is_parli") & F.col("division").isin("jv", "novice")
    # A tournament whose override names no event of its own falls back to the owned ones.
    has_field = live.groupBy("tournament_id").agg(F.bool_or("in_field").alias("_has"))
    live = cut_lineage(live.join(has_field, "tournament_id").withColumn(
        "counts", F.when(F.col("_has"), F.col("in_field")).otherwise(F.col("owned"))))
    ours = live.groupBy("tournament_id").agg(
        F.sum(F.when(F.col("counts"), F.col("field_size"))).cast("int").alias("our_open"),
        F.count_if("counts").alias("n_open"),
        F.sum(F.when(supported, F.col("field_size"))).cast("int").alias("our_njv"),
        F.sum(F.when(F.col("counts"), F.col("elim_field"))).cast("int").alias("our_elim"),
        F.max(F.when(F.col("counts"), F.col("prelim_count"))).alias("our_prelims"))
    out = ours
    if perf is not None:
        record = lowest_breaking_record(
            perf.join(live.where("owned").select("event_id", "tournament_id"), EVENT), ["tournament_id"])
        out = out.join(record, "tournament_id", "left")
    published = ["open_field", "afs", "open_elim_field", "break_pct", "prelim_count"]
    if sheet is not None:
        out = out.join(sheet.select(
            "tournament_id", *[F.col(c).alias(f"s_{c}") for c in published],
            F.col("breaking_wins").alias("s_wins"), F.col("breaking_losses").alias("s_losses")),
            "tournament_id", "left")

    def pick(name: str, computed: Column) -> Column:
        if sheet is None or not fields_from_sheet:
            return computed
        return F.coalesce(F.col(f"s_{name}"), computed)

    open_field = pick("open_field", F.coalesce("our_open", F.lit(0)))
    njv = F.when(F.col("n_open") > 1, 0).otherwise(F.coalesce("our_njv", F.lit(0)))
    elim = pick("open_elim_field", F.coalesce("our_elim", F.lit(0)))
    pct = F.when(F.col("open_field") > 0, 100.0 * F.col("elim_field") / F.col("open_field")).otherwise(0.0)
    said = F.lit(False) if sheet is None or not record_from_sheet else F.col("s_wins").isNotNull()

    def breaking(part: str, from_sheet: str) -> Column:
        own = F.col(f"breaking_{part}")
        return own if sheet is None else F.when(said, F.col(from_sheet)).otherwise(own)

    return (out.withColumn("open_field", open_field).withColumn("njv_field", njv)
            .withColumn("afs", pick("afs", F.col("open_field") + F.col("njv_field")))
            .withColumn("elim_field", elim).withColumn("break_pct", pick("break_pct", pct))
            .withColumn("prelim_count", pick("prelim_count", F.col("our_prelims")))
            .select("tournament_id", "open_field", "njv_field", "afs", "elim_field", "break_pct",
                    "prelim_count", *([] if perf is None else [breaking("wins", "s_wins").alias("breaking_wins"),
                                                               breaking("losses", "s_losses").alias("breaking_losses")])))


def clears_minimums(candidates: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per tournament: enough schools, teams and prelims for its own entry list to be used."""
    seen = (candidates.groupBy("tournament_id")
            .agg(F.count_distinct("school_id").alias("schools"), F.count("*").alias("teams")))
    ok = ((F.col("schools") >= MIN_SCHOOLS) & (F.col("teams") >= MIN_TEAMS)
          & (F.col("prelim_count") >= MIN_PRELIMS))
    return (contexts.select("tournament_id", "prelim_count").join(seen, "tournament_id", "left")
            .select("tournament_id", F.coalesce(ok, F.lit(False)).alias("clears")))
