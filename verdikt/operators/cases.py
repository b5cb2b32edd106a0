"""The scoring fact: every result with our points, the published ones, and each component."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from verdikt.functions.rules import prelim_points, score_ballot_schedule, score_entries, team_size_gate
from verdikt.functions.text import (pair_key, parse_record, people_from_label, school_key, team_key)
from verdikt.operators.brackets import clears_minimums, tournament_context
from verdikt.operators.lineage import cut_lineage
from verdikt.operators.matching import match_teams, resolve_school

# Tournaments whose events are chosen by name. (tournament, owned event, field event)
EVENT_OVERRIDES = (
    (r"(?i)^NPDL Round Robin$", r"(?i)round\s*robin", r"(?i)open\s*parli"),
    (r"(?i)^NPDL Nationals$", r"(?i)open\s*parli", None),
)
# The tournament that pays per ballot, qualifier categories and their points.
BALLOT_SCHEDULE = r"(?i)NPDL-TOC"
QUALIFIER_CATEGORIES = ("CHSSA", "OSAA")
QUALIFIER_POINTS = {"qual": 8, "alt": 4}


@dataclass(frozen=True)
class InputSources:
    """Where each input is read from: the published sheet, or our own computation."""

    fields: str = "sheet"
    breaking_record: str = "sheet"
    walkover: str = "sheet"
    entries: str = "sheet"


ALL_SHEET = InputSources()
ALL_OURS = InputSources("ours", "ours", "ours", "ours")


def input_sources(**ours: str) -> InputSources:
    """Sheet inputs except those named."""
    return InputSources(**{**ALL_SHEET.__dict__, **ours})


def owned_events(tournament: Column | str, name: Column | str, parli: Column, division: Column,
                 field: bool = False) -> Column:
    """Whether an event holds its tournament's results, or with ``field`` its field."""
    t, e = (F.col(c) if isinstance(c, str) else c for c in (tournament, name))
    out = parli & (division == "open")
    for pattern, event, field_event in reversed(EVENT_OVERRIDES):
        chosen = (field_event or event) if field else event
        out = F.when(F.coalesce(t.rlike(pattern), F.lit(False)), e.rlike(chosen)).otherwise(out)
    return out


def field_events(tournament, name, parli, division) -> Column:
    return owned_events(tournament, name, parli, division, field=True)


def candidates_from(entries: DataFrame, students: DataFrame) -> DataFrame:
    """Entries with their people: registered students with a surname, else read off the label."""
    sid = (entries.select("tournament_id", "event_id", "entry_id", F.posexplode("student_ids").alias("i", "student_id"))
           .join(students, ["tournament_id", "student_id"]).where(F.coalesce("last", F.lit("")) != "")
           .groupBy("tournament_id", "event_id", "entry_id")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "first", "last"))), lambda x: F.struct(
               x["first"].alias("first"), x["last"].alias("last"))).alias("students")))
    out = entries.join(sid, ["tournament_id", "event_id", "entry_id"], "left")
    return (out.withColumn("people", F.coalesce("students", people_from_label("name", "code")))
            .where(F.size("people") > 0).drop("students"))


def _qualifier(category: Column, result: Column) -> Column:
    word = F.lower(F.coalesce(result, F.lit("")))
    points = None
    for name, value in QUALIFIER_POINTS.items():
        points = F.when(word == name, value) if points is None else points.when(word == name, value)
    return F.when(category.isin(*QUALIFIER_CATEGORIES), points)


def _score(df: DataFrame) -> DataFrame:
    """Points of each row under the schedule its tournament uses, one column per component.

    The three schedules read the same row, so rows are scored where they are and
    none is moved. Reads perf, context, ``walkover``, ``qualifier`` and ``ballot_schedule``.
    """
    base = df.withColumn("walkover_adjustment", F.col("walkover")).drop("points", "base_points")
    pick = ["points", "base_points", "break_penalty", "floor_applied"]
    plain = score_entries(base)
    plain = plain.withColumnsRenamed({c: f"_e_{c}" for c in pick}).drop("excluded").withColumnRenamed("broke", "_e_broke")
    both = score_ballot_schedule(plain.withColumn("broke", F.col("elim_level").isNotNull())
                                 .withColumn("champion", F.coalesce(F.col("elim_level") == "first", F.lit(False))))
    q, b = F.col("qualifier"), F.col("ballot_schedule")
    choose = lambda c, quiet: F.when(q.isNotNull(), quiet).when(b, F.col(c)).otherwise(F.col(f"_e_{c}"))
    return both.select(
        *[F.col(c) for c in base.columns],
        choose("points", q).cast("double").alias("ours"), choose("base_points", q).cast("double").alias("our_base"),
        F.when(q.isNotNull() | b, 0).otherwise(F.col("prelim_count_adjustment")).alias("our_prelim_adj"),
        choose("break_penalty", F.lit(0)).alias("our_break_penalty"),
        F.when(q.isNotNull(), 0).when(b, F.col("walkover")).otherwise(F.col("walkover_applied")).alias("our_walkover"),
        choose("floor_applied", F.lit("none")).alias("our_floor"),
        F.when(q.isNotNull(), F.col("elim_level").isNotNull()).otherwise(F.col("broke")).alias("broke"))


CASE_COLUMNS = ["tournament", "category", "tournament_id", "school", "hybrid_school", "team", "pair", "entry_id",
                "partner1", "partner2", "match_tier", "match_ambiguous", "provenance", "ours", "theirs", "matched",
                "broke", "hybrid", "our_base", "their_base", "our_adj", "their_adj", "our_prelim_adj",
                "our_break_penalty", "our_walkover", "our_floor", "unlisted"]


def _case(df: DataFrame) -> DataFrame:
    theirs = F.coalesce("calc_points", F.lit(0)).cast("double")
    return df.select(
        "tournament", F.coalesce(F.nullif("category", F.lit("")), F.lit("(none)")).alias("category"),
        F.coalesce("tournament_id", F.lit("")).alias("tournament_id"), "school",
        F.nullif("school2", F.lit("")).alias("hybrid_school"), team_key("school", "partner1", "partner2").alias("team"),
        pair_key("partner1", "partner2").alias("pair"), "entry_id", "partner1", "partner2", "match_tier",
        "match_ambiguous", "provenance", F.col("ours").cast("double").alias("ours"), theirs.alias("theirs"),
        (F.col("ours") == theirs).alias("matched"), "broke", F.coalesce("hybrid_row", F.lit(False)).alias("hybrid"),
        F.col("our_base").cast("double").alias("our_base"), F.col("base_row").cast("double").alias("their_base"),
        (F.col("our_prelim_adj") + F.col("our_break_penalty")).alias("our_adj"),
        F.col("adj_row").alias("their_adj"), "our_prelim_adj", "our_break_penalty", "our_walkover", "our_floor",
        "unlisted")


def _unscored(df: DataFrame, points: Column, provenance: Column) -> DataFrame:
    """A case whose points come from a table rather than from rounds."""
    key = F.regexp_replace(F.concat_ws("_", provenance, "tournament", pair_key("partner1", "partner2")), r"\s+", "_")
    return _case(df.withColumns({
        "provenance": provenance, "ours": points, "our_base": points, "entry_id": key,
        "match_tier": F.lit("exact-surnames"), "match_ambiguous": F.lit(False), "broke": F.lit(False),
        "our_prelim_adj": F.lit(0), "our_break_penalty": F.lit(0), "our_walkover": F.lit(0),
        "our_floor": F.lit(None).cast("string"), "unlisted": F.lit(False)}))


def fallback_scores(rows: DataFrame, manual: DataFrame) -> DataFrame:
    """Adds ``fallback`` points and provenance to rows no entry was found for: entered by hand,
    a qualifier's place, or a qualifier's plain record; null when none applies."""
    qualifies = F.col("category").isin(*QUALIFIER_CATEGORIES)
    q = _qualifier(F.col("category"), F.col("result"))
    record = F.when(qualifies & parse_record("result", 1).isNotNull(),
                    prelim_points(parse_record("result", 1), parse_record("result", 2)))
    hand = manual.select("tournament", "pair", F.col("points").alias("_manual"))
    return (rows.withColumn("pair", pair_key("partner1", "partner2")).join(hand, ["tournament", "pair"], "left")
            .withColumn("fallback", F.coalesce(F.col("_manual").cast("double"), q.cast("double"), record.cast("double")))
            .withColumn("provenance", F.when(F.col("_manual").isNotNull(), "manual")
                        .when(F.col("fallback").isNotNull(), "sheet-record")).drop("_manual", "pair"))


@dataclass
class SeasonCases:
    cases: DataFrame
    unmatched: DataFrame
    ambiguous: DataFrame
    skipped: DataFrame


def season_cases(tournaments: DataFrame, rows: DataFrame, payload: DataFrame, events: DataFrame, stats: DataFrame,
                 perf: DataFrame, entries: DataFrame, students: DataFrame, schools: DataFrame, manual: DataFrame,
                 incomplete: DataFrame, sources: InputSources = ALL_SHEET) -> SeasonCases:
    """tournaments: the published list (with ``ahead``); rows: published entries; payload:
    tournament_id name; the rest as read from payloads. ``schools`` is a school index."""
    off = tournaments.select(F.col("name").alias("tournament"), "tournament_id", "category", "ahead",
                             *[c for c in ("open_field", "afs", "open_elim_field", "break_pct", "prelim_count",
                                           "breaking_wins", "breaking_losses")])
    listed = rows.select("tournament").distinct().withColumn("_listed", F.lit(True))
    held = payload.select("tournament_id", F.col("name").alias("payload_name")).withColumn("_held", F.lit(True))
    off = (off.join(listed, "tournament", "left").where(F.col("_listed") | (F.col("ahead") & F.col("tournament_id").isNotNull()))
           .join(held, "tournament_id", "left")
           .join(incomplete.select("tournament").distinct().withColumn("_incomplete", F.lit(True)), "tournament", "left"))
    off = cut_lineage(off.withColumn("usable", F.col("_held").isNotNull() & F.col("_incomplete").isNull()))
    named = off.where("usable").select("tournament_id", "tournament")
    chosen = events.join(named, "tournament_id").select(
        "tournament_id", "event_id", "division", "is_parli",
        owned_events("tournament", "name", F.col("is_parli"), F.col("division")).alias("owned"),
        field_events("tournament", "name", F.col("is_parli"), F.col("division")).alias("in_field"))
    chosen = cut_lineage(chosen)
    live = chosen.where("owned").join(stats.where(~F.col("phantom")).select("event_id"), "event_id", "left_semi")
    has_open = live.select("tournament_id").distinct().withColumn("_open", F.lit(True))
    off = cut_lineage(off.join(has_open, "tournament_id", "left"))
    context = cut_lineage(tournament_context(chosen, stats, perf, off.where("_open").select(
        "tournament_id", "open_field", "afs", "open_elim_field", "break_pct", "prelim_count", "breaking_wins",
        "breaking_losses"), sources.fields == "sheet", sources.breaking_record == "sheet"))

    cand = cut_lineage(resolve_school(candidates_from(
        entries.join(live.select("event_id"), "event_id", "left_semi"), students), "school_name", schools))
    ready = off.where("_open").select("tournament_id", "tournament", "category", "payload_name")
    scored_rows = rows.select(
        "tournament", "row_idx", F.col("school1").alias("school"), "school2", "partner1", "partner2", "result",
        F.col("walkover_adjustment").alias("walkover_row"), "calc_points", F.col("base_points").alias("base_row"),
        F.col("break_prelim_adjustment").alias("adj_row"), F.col("hybrid").alias("hybrid_row"))
    open_rows = scored_rows.join(ready, "tournament")
    open_rows = cut_lineage(open_rows)
    found = cut_lineage(match_teams(open_rows, cand.select("tournament_id", "entry_id", "school_name", "people"),
                                    "tournament_id"))

    clears = clears_minimums(cand.select("tournament_id", F.coalesce("school_id", school_key("school_name"))
                                         .alias("school_id")), context)
    ours_decide = cut_lineage(clears.where("clears") if sources.entries == "ours" else clears.limit(0)).select("tournament_id")
    facts = perf.select("event_id", "entry_id", "wins", "losses", "elim_level", "prelim_ballots_won", "elim_wins",
                        F.col("walkover_adjustment").alias("walkover_ours"))

    def with_walkover(df: DataFrame) -> DataFrame:
        w = F.coalesce("walkover_row", F.lit(0)) if sources.walkover == "sheet" else F.col("walkover_ours")
        return (df.withColumn("walkover", w.cast("int"))
                .withColumn("qualifier", _qualifier(F.col("category"), F.col("result")))
                .withColumn("ballot_schedule", F.coalesce(F.col("tournament").rlike(BALLOT_SCHEDULE), F.lit(False))))

    # The sheet decides which rows exist.
    hits = found.where(F.col("entry_id").isNotNull() & ~F.col("ambiguous")).join(
        ours_decide, "tournament_id", "left_anti")
    sheet_led = (hits.withColumnRenamed("tier", "match_tier").drop("score", "ambiguous")
                 .join(cand.select("tournament_id", "entry_id", "event_id", "eligible_team_size"),
                       ["tournament_id", "entry_id"])
                 .join(facts, ["event_id", "entry_id"]).join(context, "tournament_id"))
    sheet_cases = _case(_score(with_walkover(sheet_led)).withColumns({
        "match_ambiguous": F.lit(False), "provenance": F.lit("rounds"), "unlisted": F.lit(False)}))

    # The payload decides: every candidate of a known school, with its row where one was found.
    qualifying = (open_rows.where(F.col("category").isin(*QUALIFIER_CATEGORIES)
                                  & F.lower("result").isin(*QUALIFIER_POINTS)).select("tournament_id").distinct()
                  .withColumn("_qualifying", F.lit(True)))
    sure = found.where(F.col("entry_id").isNotNull() & ~F.col("ambiguous")).select(
        "tournament_id", "entry_id", "school", "school2", "partner1", "partner2", "result", "walkover_row",
        "calc_points", "base_row", "adj_row", "hybrid_row", F.lit(True).alias("_row"))
    payload_led = (cand.where(F.col("school_id").isNotNull()).join(ours_decide, "tournament_id")
                   .join(ready, "tournament_id").join(sure, ["tournament_id", "entry_id"], "left")
                   .join(qualifying, "tournament_id", "left")
                   .join(facts, ["event_id", "entry_id"]).join(context, "tournament_id"))
    own = lambda i: F.coalesce(F.get("people", F.lit(i))["last"], F.lit(""))
    payload_led = with_walkover(payload_led).where(F.col("qualifier").isNotNull() | F.col("_qualifying").isNull())
    payload_led = payload_led.withColumns({
        "school": F.coalesce("school", "school_name", F.lit("")), "partner1": F.coalesce("partner1", own(0)),
        "partner2": F.coalesce("partner2", own(1))})
    payload_cases = _case(_score(payload_led).withColumns({
        "tournament": F.coalesce(F.nullif("tournament", F.lit("")), "payload_name"),
        "match_tier": F.lit("exact-surnames"), "match_ambiguous": F.lit(False), "provenance": F.lit("rounds"),
        "unlisted": F.col("_row").isNull()}))

    # Rows nothing was found for, and rows of tournaments without a usable payload.
    lost = fallback_scores(found.where(F.col("entry_id").isNull()).drop("tier", "score", "ambiguous", "entry_id"), manual)
    lost_cases = _unscored(lost.where(F.col("fallback").isNotNull()), F.col("fallback"), F.col("provenance"))
    bare = (scored_rows.join(off.where(~F.col("usable")).select("tournament", "category"), "tournament")
            .withColumn("tournament_id", F.lit("")).withColumn("pair", pair_key("partner1", "partner2"))
            .join(manual.select("tournament", "pair", F.col("points").alias("_m")), ["tournament", "pair"], "left"))
    bare_cases = _unscored(bare.where(F.col("_m").isNotNull()), F.col("_m").cast("double"), F.lit("manual"))

    team = team_key("school", "partner1", "partner2").alias("team")
    unmatched = (lost.where(F.col("fallback").isNull()).select("tournament", team)
                 .union(bare.where(F.col("_m").isNull()).select("tournament", team)))
    ambiguous = (found.where("ambiguous").join(ours_decide, "tournament_id", "left_anti").select("tournament", team))
    skipped = off.where(~F.col("usable") | F.col("_open").isNull()).select("tournament")
    cases = sheet_cases.unionByName(payload_cases).unionByName(lost_cases).unionByName(bare_cases)
    return SeasonCases(cases.select(*CASE_COLUMNS), unmatched, ambiguous, skipped)


def credit_school(entries: DataFrame, cases: DataFrame, index: DataFrame) -> DataFrame:
    """The league's school over the payload's, and a hybrid's second school."""
    said = cases.select("entry_id", F.col("school").alias("_league"), "hybrid_school")
    out = resolve_school(entries.drop("school_id").join(said, "entry_id", "left"), "_league", index, "l_")
    out = resolve_school(out, "school_name", index, "p_")
    out = resolve_school(out, "hybrid_school", index, "h_")
    return (out.withColumn("school_id", F.coalesce("l_school_id", "p_school_id"))
            .withColumn("school_title", F.coalesce("l_school_title", "p_school_title"))
            .withColumn("hybrid_school_id", F.col("h_school_id"))
            .drop("_league", "hybrid_school", *[f"{p}_school_{c}" for p in "lph" for c in ("id", "title", "short", "member")]))


def link_debaters(entries: DataFrame, students: DataFrame) -> DataFrame:
    """(entry, debater, name): registered students, or people on the label under a stable id.

    entries: tournament_id entry_id student_ids name code school_id school_title
    """
    sid = (entries.where(F.size("student_ids") > 0)
           .select("tournament_id", "entry_id", "school_id", F.explode("student_ids").alias("student_id"))
           .join(students, ["tournament_id", "student_id"], "left")
           .select("entry_id", F.col("student_id").alias("debater_id"), "first", "last", "school_id"))
    label = (entries.where(F.size("student_ids") == 0)
             .select("entry_id", "school_id", F.coalesce("school_title", F.lit("unknown")).alias("home"),
                     F.explode(people_from_label("name", "code")).alias("p")))
    first = F.nullif("p.first", F.lit(""))
    made = F.concat_ws("_", F.lit("lbl"), school_key("home"), school_key("p.last"),
                       F.when(first.isNotNull(), school_key(first)))
    return sid.unionByName(label.select("entry_id", made.alias("debater_id"), first.alias("first"),
                                        F.col("p.last").alias("last"), "school_id"))


def entry_results(cases: DataFrame, links: DataFrame) -> DataFrame:
    """Stored results; anything but two resolved people is kept and excluded."""
    size = links.groupBy("entry_id").agg(F.count("*").cast("int").alias("people"))
    return cases.join(size, "entry_id", "left").select(
        "entry_id", F.col("ours").alias("points"), F.col("our_base").alias("base_points"),
        F.col("our_prelim_adj").alias("prelim_count_adjustment"), F.col("our_break_penalty").alias("break_penalty"),
        F.col("our_walkover").alias("walkover_adjustment"), F.col("our_floor").alias("floor_applied"),
        team_size_gate("people").alias("excluded_reason"))


def synthetic_entries(cases: DataFrame, entries: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, links) for results no payload entry stands behind."""
    bare = cases.join(entries.select("entry_id"), "entry_id", "left_anti")
    tid = F.coalesce(F.nullif("tournament_id", F.lit("")),
                     F.regexp_replace(F.concat(F.lit("manual_"), "tournament"), r"\s+", "_"))
    made = resolve_school(bare.withColumn("tournament_id", tid), "school", index, "s_")
    made = resolve_school(made, "hybrid_school", index, "h_")
    names = F.filter(F.array("partner1", "partner2"), lambda n: F.coalesce(n, F.lit("")) != "")
    out = made.select(
        "entry_id", "tournament_id", F.concat("tournament_id", F.lit("_manual")).alias("event_id"),
        F.concat_ws(" ", "school", F.array_join(names, " & ")).alias("code"), F.col("s_school_id").alias("school_id"),
        F.col("h_school_id").alias("hybrid_school_id"), F.size(names).alias("team_size"))
    home = school_key(F.coalesce("s_school_title", "school"))
    links = made.select("entry_id", F.explode(names).alias("last"), home.alias("home"), "s_school_id").select(
        "entry_id", F.concat_ws("_", F.lit("lbl"), "home", school_key("last")).alias("debater_id"),
        F.lit(None).cast("string").alias("first"), "last", F.col("s_school_id").alias("school_id"))
    return out, links


def missing_debater_link(results: DataFrame, links: DataFrame) -> DataFrame:
    """Scored results nobody is linked to; there should be none."""
    return (results.where(F.col("excluded_reason").isNull() & (F.col("points") > 0))
            .join(links.select("entry_id"), "entry_id", "left_anti"))


def load_our_teams(totals: DataFrame, people: DataFrame, schools: DataFrame) -> DataFrame:
    """Team totals with both names and the school's short name."""
    out = totals.join(schools.select("school_id", F.coalesce("short_name", "name").alias("school")), "school_id", "left")
    for i in ("1", "2"):
        out = out.join(people.select(F.col("debater_id").alias(f"debater{i}_id"), F.col("first").alias(f"first{i}"),
                                     F.col("last").alias(f"last{i}")), f"debater{i}_id")
    return out.where("last1 <> '' and last2 <> ''").withColumn("team_id", F.concat_ws("_", F.lit("team"), "season_id", "pair"))
