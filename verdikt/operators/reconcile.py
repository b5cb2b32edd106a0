"""Agreement with published figures: per result, per team, per input, by slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from verdikt.functions.rules import WEIGHTS
from verdikt.functions.text import norm_name, pair_key, school_key
from verdikt.operators.cases import BALLOT_SCHEDULE
from verdikt.operators.ranking import competition_rank, first_of_each, sequence_number, weighted_total

# How far apart two totals may be and still agree, and the rank tiers.
EPSILON = 0.051
TIERS = (("top 25", 0, 25), ("26-100", 25, 100), ("101-300", 100, 300), ("301+", 300, None))


def _share(hit: Column, name: str = "agree") -> list[Column]:
    return [F.count("*").cast("int").alias("n"), F.count_if(hit).cast("int").alias(name)]


def disagreements(cases: DataFrame) -> DataFrame:
    """Listed results that differ, with the trail of components."""
    return cases.where(~F.col("matched") & ~F.col("unlisted")).select(
        "entry_id", "tournament_id", F.col("ours").alias("our_value"), F.col("theirs").alias("official_value"),
        F.struct("tournament", "school", "match_tier", "our_base", "their_base", "our_adj", "their_adj", "broke")
        .alias("detail"), F.lit("open").alias("status"))


def counted_set(results: DataFrame, keys: list[str], points: str, order: list[str]) -> DataFrame:
    """The results of each key that count: the best five."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(points), *[F.asc(c) for c in order]))
    return results.withColumn("_place", place).where(F.col("_place") <= len(WEIGHTS)).drop("_place")


def standing_diagnostics(teams: DataFrame, theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """Per published team, every tournament either side has, and what each says.

    teams: season_id team_key team_id official_rank official_points our_points; theirs:
    season_id team_key tournament points order; ours: season_id team_id tournament points provenance.
    """
    keys = ["season_id", "team_key"]
    counted = counted_set(theirs, keys, "points", ["order"]).select(*keys, "order", F.lit(True).alias("counted"))
    # A team's first row at a tournament is the one compared.
    pub = (theirs.join(counted, [*keys, "order"], "left").groupBy(*keys, "tournament")
           .agg(F.min_by(F.struct("points", "counted"), "order").alias("p"))
           .select(*keys, "tournament", F.col("p.points").alias("official"),
                   F.coalesce("p.counted", F.lit(False)).alias("counted")))
    pub = pub.join(teams.select(*keys), keys, "left_semi")
    mine = (ours.groupBy("season_id", "team_id", "tournament").agg(F.max(F.struct("points", "provenance")).alias("m"))
            .join(teams.where(F.col("team_id").isNotNull()).select(*keys, "team_id"), ["season_id", "team_id"])
            .select(*keys, "tournament", F.col("m.points").alias("ours"), F.col("m.provenance").alias("provenance")))
    both = pub.join(mine, [*keys, "tournament"], "full_outer").withColumn(
        "delta", F.col("ours") - F.col("official")).withColumn("counted", F.coalesce("counted", F.lit(False)))
    # One element per tournament the team attended in the season.
    result = F.struct((-F.coalesce("official", F.lit(0.0))).alias("rank_key"), "tournament", "official", "ours", "delta",
                      "counted", F.coalesce("provenance", F.lit("missing")).alias("provenance"))
    wrong = F.col("ours").isNull() | F.col("delta").isNull() | (F.col("delta") != 0)
    nested = both.groupBy(*keys).agg(F.array_sort(F.collect_list(result)).alias("results"),
                                     F.count_if(wrong).cast("int").alias("mismatched_results"))
    return (teams.join(nested, keys, "left").fillna(0, ["mismatched_results"])
            .withColumn("delta", F.col("our_points") - F.col("official_points")))


def backtest_fields(ours: DataFrame, published: DataFrame) -> DataFrame:
    """Five field figures against the published ones, scored only where published.

    Both: tournament_id open_field njv_field afs elim_field prelim_count.
    """
    names = ["open_field", "njv_field", "afs", "elim_field", "prelim_count"]
    said = published.withColumn("njv_field", F.coalesce("njv_field", F.lit(0)))
    both = ours.join(said.select("tournament_id", *[F.col(c).alias(f"t_{c}") for c in names]), "tournament_id")
    pairs = F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("ours"),
                               F.col(f"t_{c}").cast("double").alias("theirs")) for c in names])
    return (both.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("theirs").isNotNull())
            .groupBy("figure").agg(*_share(F.col("ours") == F.col("theirs"))))


def backtest_figures(events: DataFrame, stats: DataFrame) -> DataFrame:
    """Our side of ``backtest_fields``: unlike scoring, middle-school fields count as support."""
    live = events.where("is_parli").join(stats.where(~F.col("phantom")), "event_id")
    is_open = F.col("division") == "open"
    support = F.col("division").isin("jv", "novice", "middle")
    out = live.groupBy("tournament_id").agg(
        F.sum(F.when(is_open, F.col("field_size"))).alias("open_field"),
        F.coalesce(F.sum(F.when(support, F.col("field_size"))), F.lit(0)).alias("njv_field"),
        F.sum(F.when(is_open, F.col("elim_field"))).alias("elim_field"),
        F.max(F.when(is_open, F.col("prelim_count"))).alias("prelim_count"))
    return out.where(F.col("open_field").isNotNull()).withColumn("afs", F.col("open_field") + F.col("njv_field"))


def _toc() -> Column:
    return F.coalesce(F.col("tournament").rlike(BALLOT_SCHEDULE), F.lit(False))


def backtest_points(cases: DataFrame) -> DataFrame:
    """Agreement per slice, every slice from one pass over the listed cases."""
    cat = F.col("category")
    tag = lambda test, name: F.when(test, F.struct(F.lit(name).alias("slice"), F.col("matched").alias("ok")))
    labels = [
        F.struct(F.lit("all").alias("slice"), F.col("matched").alias("ok")),
        tag(_toc(), "type: ballot schedule"),
        F.when(~(_toc() & (cat == "Regular")), F.struct(F.concat(F.lit("category: "), cat).alias("slice"),
                                                        F.col("matched").alias("ok"))),
        tag(F.col("broke"), "result: broke"), tag(~F.col("broke"), "result: prelims only"),
        tag(F.col("hybrid"), "hybrid"), tag(F.col("match_ambiguous"), "flagged ambiguous"),
        F.struct(F.concat(F.lit("tier: "), "match_tier").alias("slice"), F.col("matched").alias("ok")),
        F.when(F.col("broke"), F.struct(F.lit("component: base").alias("slice"),
                                        F.col("our_base").eqNullSafe(F.col("their_base")).alias("ok"))),
        F.when(F.col("broke") & F.col("their_adj").isNotNull(),
               F.struct(F.lit("component: adjustment").alias("slice"), (F.col("our_adj") == F.col("their_adj")).alias("ok"))),
    ]
    each = cases.where(~F.col("unlisted")).select(F.explode(F.array_compact(F.array(*labels))).alias("s"))
    return each.groupBy("s.slice").agg(F.count("*").cast("int").alias("n"),
                                       F.count_if("s.ok").cast("int").alias("agree"))


def worst_tournaments(cases: DataFrame, top: int = 12) -> DataFrame:
    """Each season's tournaments with most differing results."""
    counts = (cases.where(~F.col("unlisted")).groupBy("season_id", "tournament")
              .agg(F.count_if(~F.col("matched")).cast("int").alias("bad"), F.count("*").cast("int").alias("total")).where("bad > 0"))
    return first_of_each(counts, ["season_id"], [F.desc("bad"), F.asc("tournament")], top)


def delta_histogram(cases: DataFrame, samples: int = 3) -> DataFrame:
    """Differing results per delta, with a few example entries.

    The examples are picked by a pruned row number, so a delta shared by a third
    of all results is not gathered.
    """
    bad = cases.where(~F.col("matched") & ~F.col("unlisted")).withColumn("delta", F.col("ours") - F.col("theirs"))
    place = F.row_number().over(W.partitionBy("delta").orderBy("entry_id"))
    shown = (bad.select("delta", "entry_id").withColumn("_p", place).where(F.col("_p") <= samples)
             .groupBy("delta").agg(F.array_join(F.array_sort(F.collect_list("entry_id")), ",").alias("samples")))
    return bad.groupBy("delta").agg(F.count("*").cast("int").alias("n")).join(shown, "delta")


def backtest_aggregates(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """A season's person and school totals, over competitors every result of whom we have.

    rows: published entries (season_id tournament school1 school2 partner1 partner2 calc_points row_idx).
    """
    mine = (cases.where(~F.col("unlisted")).groupBy("season_id", "tournament", "pair")
            .agg(F.max_by("ours", "entry_id").alias("ours")))
    both = (rows.where(~F.col("incorrect_team_size")).withColumn("pair", pair_key("partner1", "partner2"))
            .join(mine, ["season_id", "tournament", "pair"], "left")
            .withColumn("theirs", F.coalesce("calc_points", F.lit(0)).cast("double"))
            .withColumn("second", F.coalesce(F.nullif("school2", F.lit("")), "school1")))
    person = lambda school, p: F.concat_ws("|", F.col(school), norm_name(p))
    each = both.select("season_id", "row_idx", "tournament", "ours", "theirs", F.explode(F.array(
        person("school1", "partner1"), person("second", "partner2"))).alias("person"))
    keys = ["season_id", "person"]
    whole = each.groupBy(*keys).agg(F.bool_and(F.col("ours").isNotNull()).alias("complete")).where("complete")
    kept = each.join(whole, keys, "left_semi")
    order = ["tournament", "row_idx"]
    a = weighted_total(kept, keys, "ours", order).select(*keys, F.col("points").alias("o"))
    b = weighted_total(kept, keys, "theirs", order).select(*keys, F.col("points").alias("t"))
    people = a.join(b, keys).groupBy("season_id").agg(*_share(F.abs(F.col("o") - F.col("t")) < EPSILON)).withColumn("scope", F.lit("people"))
    hybrid = F.coalesce("school2", F.lit("")) != ""
    share = F.when(hybrid, 0.5).otherwise(1.0)
    school = (both.select("season_id", "ours", "theirs", share.alias("w"), F.explode(
        F.when(hybrid, F.array("school1", "school2")).otherwise(F.array("school1"))).alias("school"))
        .groupBy("season_id", "school").agg(F.sum(F.col("ours") * F.col("w")).alias("o"), F.sum(F.col("theirs") * F.col("w")).alias("t"))
        .where(F.col("o").isNotNull()))
    schools = school.groupBy("season_id").agg(*_share(F.abs(F.col("o") - F.col("t")) < 0.51)).withColumn("scope", F.lit("schools"))
    return people.unionByName(schools).select("season_id", "scope", "n", "agree")


def compare_teams(official: DataFrame, cases: DataFrame) -> DataFrame:
    """Published teams of each season with our weighted total and what it is made of.

    official: season_id team rank region points n_theirs.
    """
    listed, keys = cases.where(~F.col("unlisted")), ["season_id", "team"]
    made = listed.groupBy(*keys).agg(
        F.count("*").cast("int").alias("n_ours"), F.bool_and("matched").alias("all_matched"),
        F.bool_or("hybrid").alias("hybrid"), F.bool_or("broke").alias("broke"), F.bool_or(_toc()).alias("toc"),
        F.array_sort(F.collect_set("category")).alias("categories"))
    total = weighted_total(listed, keys, "ours", ["entry_id"]).select(*keys, F.col("points").alias("our_points"))
    return official.join(made, keys).join(total, keys).withColumn("delta", F.col("our_points") - F.col("points"))


def backtest_teams(compared: DataFrame) -> DataFrame:
    """Exact, within a half and within two, by season and slice, from one pass."""
    rank = F.coalesce("rank", F.lit(1_000_000_000))
    tiers = [F.when((rank > lo) & (rank <= hi if hi else F.lit(True)), F.lit(f"tier: {name}")) for name, lo, hi in TIERS]
    clean = F.col("all_matched") & (F.col("n_ours") >= F.col("n_theirs"))
    labels = [F.lit("all"), F.when(clean, F.lit("every result agrees")),
              F.when(F.col("n_theirs").between(1, 5), F.concat(F.lit("tournaments: "), F.col("n_theirs").cast("string"))),
              *tiers, F.when(F.coalesce("region", F.lit("")) != "", F.concat(F.lit("region: "), "region")),
              F.when(F.col("hybrid"), F.lit("hybrid")).otherwise(F.lit("single-school")),
              F.when(F.col("broke"), F.lit("ever broke")).otherwise(F.lit("prelims only")),
              F.when(F.col("toc"), F.lit("any ballot schedule"))]
    slices = F.concat(F.array_compact(F.array(*labels)),
                      F.transform("categories", lambda c: F.concat(F.lit("any "), c)))
    gap = F.abs("_d")
    out = (compared.select("season_id", F.col("delta").alias("_d"), F.explode(slices).alias("slice")).groupBy("season_id", "slice")
           .agg(F.count("*").cast("int").alias("n"), F.count_if(gap <= EPSILON).cast("int").alias("exact"),
                F.count_if(gap <= 0.5).cast("int").alias("within_half"),
                F.count_if(gap <= 2.0).cast("int").alias("within_two")))
    return out.where(~F.col("slice").startswith("region: ") | (F.col("n") >= 5))


def rank_agreement(compared: DataFrame) -> DataFrame:
    """Our order of a season against the published one: exact, within five and within twenty places."""
    keys = ["season_id"]
    ours = sequence_number(compared.select(*keys, "team", "our_points", "points"), keys, "our_points", [F.asc("team")], "our_place")
    both = competition_rank(ours, keys, "points", "their_place")
    gap = F.abs(F.col("our_place") - F.col("their_place"))
    return both.groupBy(*keys).agg(F.count("*").cast("int").alias("n"), F.count_if(gap == 0).cast("int").alias("exact"),
                    F.count_if(gap <= 5).cast("int").alias("within_5"),
                    F.count_if(gap <= 20).cast("int").alias("within_20"))


def miss_causes(compared: DataFrame) -> DataFrame:
    cause = (F.when(F.col("n_ours") < F.col("n_theirs"), "missing tournament")
             .when(~F.col("all_matched"), "an entry differs").otherwise("total differs"))
    return (compared.where(F.abs("delta") > EPSILON).groupBy("season_id", cause.alias("cause"))
            .agg(F.count("*").cast("int").alias("teams")))


def _agrees() -> Column:
    return F.abs(F.col("ours") - F.col("theirs")) < EPSILON


def compare_sources(runs: DataFrame) -> DataFrame:
    """Input configurations side by side, per category and overall.

    runs: config and the cases computed under it; only results scored from rounds are compared.
    """
    usable = runs.where((F.col("provenance") == "rounds") & ~F.col("unlisted"))
    slices = F.explode(F.array(F.lit("all"), F.col("category"))).alias("slice")
    return usable.select("config", slices, "ours", "theirs").groupBy("config", "slice").agg(*_share(_agrees()))


def blame_sources(runs: DataFrame, base: str, final: str) -> DataFrame:
    """Results one configuration wins and the other loses, and which single input explains it."""
    usable = runs.where((F.col("provenance") == "rounds") & ~F.col("unlisted")).withColumn("ok", _agrees())
    per = usable.groupBy("entry_id", "tournament").agg(
        F.max(F.when(F.col("config") == base, F.col("ok"))).alias("base_ok"),
        F.max(F.when(F.col("config") == final, F.col("ok"))).alias("final_ok"),
        F.array_sort(F.collect_set(F.when(~F.col("config").isin(base, final) & ~F.col("ok"), F.col("config")))).alias("c"))
    cause = F.when(F.col("base_ok") & ~F.col("final_ok"),
                   F.when(F.size("c") == 0, "interaction").otherwise(F.array_join("c", " + ")))
    verdict = F.when(F.col("base_ok") & ~F.col("final_ok"), "lost").when(~F.col("base_ok") & F.col("final_ok"), "gained")
    return (per.withColumn("verdict", verdict).where(F.col("verdict").isNotNull())
            .groupBy("verdict", F.coalesce(cause, F.lit("-")).alias("cause")).agg(F.count("*").cast("int").alias("n")))


def compare_entry_sources(sheet: DataFrame, ours: DataFrame) -> DataFrame:
    """Scoring entries lost, gained and rescored when our entry list replaces the sheet's."""
    a = sheet.select("entry_id", F.col("ours").alias("a"))
    b = ours.select("entry_id", F.col("ours").alias("b"))
    both = a.join(b, "entry_id", "full_outer")
    kind = (F.when(F.col("b").isNull() & (F.col("a") > 0), "lost").when(F.col("a").isNull() & (F.col("b") > 0), "gained")
            .when(F.abs(F.col("a") - F.col("b")) > EPSILON, "rescored").otherwise("same"))
    return both.groupBy(kind.alias("change")).agg(F.count("*").cast("int").alias("entries"))


def compare_entry_totals(sheet: DataFrame, ours: DataFrame) -> DataFrame:
    """A season's partnership totals identical, moved or absent between the two entry lists."""
    keys = ["season_id", "team"]
    owner = sheet.select("entry_id", *keys)
    before = weighted_total(sheet.where("ours > 0"), keys, "ours", ["entry_id"]).select(
        *keys, F.col("points").alias("before"))
    after = weighted_total(ours.where("ours > 0").drop(*keys).join(owner, "entry_id"), keys, "ours",
                           ["entry_id"]).select(*keys, F.col("points").alias("after"))
    kind = (F.when(F.col("after").isNull(), "absent")
            .when(F.abs(F.col("after") - F.col("before")) < EPSILON, "identical").otherwise("moved"))
    return (before.join(after, keys, "left").groupBy("season_id", kind.alias("change"))
            .agg(F.count("*").cast("int").alias("teams")))


def check_walkovers(derived: DataFrame, published: DataFrame) -> DataFrame:
    """Derived against published adjustment, per entry. Both: entry_id walkover_adjustment."""
    both = published.select("entry_id", F.coalesce("walkover_adjustment", F.lit(0)).alias("published")).join(
        derived.select("entry_id", F.col("walkover_adjustment").alias("derived")), "entry_id")
    return both.withColumn("agrees", F.col("published") == F.col("derived"))


def compare_top(paired: DataFrame, top: int = 100) -> DataFrame:
    """How many of a season's published top agree exactly, by share and by points.

    paired: season_id scope rank label official ours.
    """
    gap = F.abs(F.col("ours") - F.col("official"))
    share = F.when(F.col("official") == 0, F.when(gap == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise(
        100 * gap / F.col("official"))
    n = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).cast("int").alias(name)
    return (paired.where(F.col("rank") <= top).groupBy("season_id", "scope")
            .agg(F.count("*").cast("int").alias("compared"), n(F.col("ours").isNull(), "unmatched"),
                 n(gap < EPSILON, "exact"), n(share <= 0.5, "within_half_pct"), n(share <= 2, "within_two_pct"),
                 n(gap <= 0.5, "within_half"), n(gap <= 2, "within_two")))


def largest_gaps(paired: DataFrame, top: int = 100, show: int = 8) -> DataFrame:
    """The widest gaps of each season's and scope's published top."""
    gap = F.col("ours") - F.col("official")
    wide = paired.where((F.col("rank") <= top) & (F.abs(gap) >= EPSILON)).select(
        "season_id", "scope", "label", "official", "ours", gap.alias("gap"))
    return first_of_each(wide, ["season_id", "scope"], [F.desc(F.round(F.abs("gap"), 6)), F.asc("label")], show)


def diagnose(cases: DataFrame, unmatched: DataFrame, ambiguous: DataFrame, skipped: DataFrame,
             teams: DataFrame) -> DataFrame:
    """A season's problem classes with rows, top teams affected and points at stake.

    All: season_id. teams: team_key rank_ok ours delta for the published top; a team is bad when absent or apart.
    """
    bad = teams.where(F.col("ours").isNull() | (F.abs("delta") >= EPSILON)).select(
        "season_id", F.col("team_key").alias("team"), F.abs(F.coalesce("delta", "official")).alias("stake"),
        F.col("ours").isNull().alias("absent"))
    wrong = cases.where(~F.col("matched"))
    label = lambda d, k, w, t: d.select("season_id", F.lit(k).alias("problem"), w.alias("place"), t.alias("team"))
    explained = unmatched.select("season_id", "team").union(wrong.select("season_id", "team")).distinct()
    loose = bad.join(explained, ["season_id", "team"], "left_anti")
    rows = (label(wrong, "scored differently", F.col("tournament"), F.col("team"))
            .union(label(unmatched, "never matched", F.col("tournament"), F.col("team")))
            .union(label(ambiguous, "ambiguous", F.col("tournament"), F.col("team")))
            .union(label(skipped.distinct(), "no usable payload", F.col("tournament"), F.lit(None).cast("string")))
            .union(loose.select("season_id", F.when(F.col("absent"), "absent from our standings").otherwise("total differs only"),
                                F.col("team"), F.col("team"))))
    counts = rows.groupBy("season_id", "problem").agg(F.count("*").cast("int").alias("rows"))
    hit = (rows.select("season_id", "problem", "team").distinct().join(bad, ["season_id", "team"]).groupBy("season_id", "problem")
           .agg(F.count("*").cast("int").alias("teams"), F.sum("stake").alias("points")))
    return counts.join(hit, ["season_id", "problem"], "left").fillna(0, ["teams"]).fillna(0.0, ["points"])


def audit_top(teams: DataFrame, results: DataFrame, cases: DataFrame, unmatched: DataFrame,
              skipped: DataFrame) -> DataFrame:
    """Each published result of a team that differs in the season, and what happened to it.

    teams: season_id team_key; results: season_id team_key tournament result points. Where ``unmatched`` has
    entry_id, results have it too: a team's other entry at the tournament is no reason for this one.
    """
    keys = ["season_id", "team", "tournament"]
    mine = cases.groupBy(*keys).agg(F.max_by("ours", "entry_id").alias("ours"))
    which = [*keys, *(["entry_id"] if "entry_id" in unmatched.columns else [])]
    lost = unmatched.select(*which).distinct().withColumn("_lost", F.lit(True))
    gone = skipped.select("tournament").distinct().withColumn("_gone", F.lit(True))
    note = (F.when(F.col("ours").isNotNull(), F.when(F.col("ours") == F.col("points"), "agrees").otherwise("scored differently"))
            .when(F.col("_lost"), "not matched").when(F.col("_gone"), "no payload").otherwise("absent"))
    return (results.join(teams.select("season_id", "team_key"), ["season_id", "team_key"], "left_semi")
            .withColumnRenamed("team_key", "team").join(mine, keys, "left").join(lost, which, "left")
            .join(gone, "tournament", "left")
            .select("season_id", "team", "tournament", "result", "points", "ours", note.alias("cause")))


# The twelve exclusion rules compared. (name, basis, least missed, drops count)
FORFEIT_RULES = (
    ("A", "missing", 2, False), ("B", "missing", 2, True), ("C", "missing", 3, False), ("D", "appeared", 2, False),
    ("E", "appeared", 2, True), ("F", "appeared", 1, True), ("G", "byeaware", 2, False), ("H", "byeaware", 2, True),
    ("I", "byeaware", 3, True), ("J", "missing", 3, True), ("K", "none", None, True), ("L", "byeaware", 2, True),
)


def forfeit_rule_sweep(entries: DataFrame, rounds: DataFrame, ballots: DataFrame, published: DataFrame) -> DataFrame:
    """Twelve exclusion rules against the published field, all from one pass over ballots.

    entries: tournament_id event_id entry_id dropped; published: tournament_id open_field.
    """
    prelims = rounds.where("is_prelim").select("event_id", "round_id")
    n = prelims.groupBy("event_id").agg(F.count("*").alias("n_prelims"))
    seen = (ballots.where(F.col("entry_id").isNotNull()).join(prelims, ["event_id", "round_id"])
            .groupBy("event_id", "entry_id")
            .agg(F.count("*").alias("appeared"), F.count("won").alias("scored"),
                 F.count_if(F.col("won").isNull() & F.col("is_bye")).alias("byes")))
    live = seen.groupBy("event_id").agg(F.max(F.col("scored") > 0).alias("any_scored"))
    each = (entries.join(seen, ["event_id", "entry_id"], "left").join(n, "event_id", "left").join(live, "event_id", "left")
            .fillna(0, ["appeared", "scored", "byes", "n_prelims"]).fillna(False, ["any_scored", "dropped"]))
    missed = {"missing": F.col("n_prelims") - F.col("scored"),
              "byeaware": F.col("n_prelims") - F.col("scored") - F.col("byes"),
              "appeared": F.col("appeared") - F.col("scored")}
    flags = [F.struct(F.lit(name).alias("rule"), (
        (F.col("dropped") if drops else F.lit(False))
        | ((F.col("any_scored") & (missed[basis] >= least)) if least else F.lit(False))).alias("out"))
        for name, basis, least, drops in FORFEIT_RULES]
    field = (each.select("tournament_id", F.explode(F.array(*flags)).alias("f")).groupBy("tournament_id", "f.rule")
             .agg(F.count_if(~F.col("f.out")).alias("ours")))
    gap = F.abs(F.col("ours") - F.col("open_field"))
    return (field.join(published.where(F.col("open_field").isNotNull()).select("tournament_id", "open_field"), "tournament_id")
            .groupBy("rule").agg(F.count("*").cast("int").alias("n"), F.count_if(gap == 0).cast("int").alias("exact"),
                                 F.count_if(gap <= 1).cast("int").alias("within_one"), F.avg(gap).alias("mean_error")))


def discover_aliases(entries: DataFrame, cases: DataFrame, index: DataFrame) -> DataFrame:
    """Registered names credited to another school, counted; confident when only one was."""
    credited = (cases.where(~F.col("hybrid") & F.col("hybrid_school").isNull())
                .select("entry_id", school_key("school").alias("key"))
                .join(index.select("key", F.col("name").alias("school"), "short_name", "school_id"), "key").drop("key"))
    both = (entries.where(F.coalesce("school_name", F.lit("")) != "").select("entry_id", "school_name")
            .join(credited, "entry_id").withColumn("raw_key", school_key("school_name")))
    same = (F.col("raw_key") == school_key("school")) | F.coalesce(
        F.col("raw_key") == school_key("short_name"), F.lit(False))
    pairs = (both.where(~same).groupBy("raw_key", "school_id", "school")
             .agg(F.count("*").cast("int").alias("n"),
                  F.min(F.trim(F.element_at(F.split("school_name", "/"), 1))).alias("alias")))
    targets = pairs.where("school <> 'Independent'").groupBy("alias").agg(F.count("*").alias("targets"))
    return pairs.join(targets, "alias", "left").select(
        "alias", "school", "n", F.coalesce(F.col("targets") == 1, F.lit(False)).alias("confident"))


def match_coverage(rows: DataFrame, found: DataFrame, usable: DataFrame) -> DataFrame:
    """Rows matched, ambiguous, unmatched or without a payload, per tournament.

    rows: tournament row_idx; found: tournament row_idx entry_id ambiguous; usable: tournament.
    """
    status = (F.when(F.col("_usable").isNull(), "no payload").when(F.col("entry_id").isNull(), "unmatched")
              .when(F.col("ambiguous"), "ambiguous").otherwise("matched"))
    return (rows.select("tournament", "row_idx")
            .join(found.select("tournament", "row_idx", "entry_id", "ambiguous"), ["tournament", "row_idx"], "left")
            .join(usable.select("tournament").distinct().withColumn("_usable", F.lit(True)), "tournament", "left")
            .groupBy("tournament", status.alias("status")).agg(F.count("*").cast("int").alias("rows")))


def field_deltas(ours: DataFrame, published: DataFrame) -> DataFrame:
    """Tournaments whose open field differs. Both: tournament_id open_field."""
    return (ours.select("tournament_id", F.col("open_field").alias("ours"))
            .join(published.select("tournament_id", F.col("open_field").alias("theirs")), "tournament_id")
            .where(F.col("theirs").isNotNull() & (F.col("ours") != F.col("theirs")))
            .withColumn("delta", F.col("ours") - F.col("theirs")))


def category_deltas(cases: DataFrame, category: Column | None = None) -> DataFrame:
    """Differing results per category, tournament and delta."""
    bad = cases.where(~F.col("matched"))
    bad = bad if category is None else bad.where(category)
    return bad.groupBy("category", "tournament", (F.col("ours") - F.col("theirs")).alias("delta")).agg(
        F.count("*").cast("int").alias("n"))


def forfeit_inspection(entries: DataFrame, rounds: DataFrame, ballots: DataFrame) -> DataFrame:
    """Entries missing any prelim: scored, byes, absent and which rounds they are absent from."""
    prelims = rounds.where("is_prelim").select("event_id", "round_id", "name")
    n = prelims.groupBy("event_id").agg(F.count("*").alias("n_prelims"),
                                        F.array_sort(F.collect_set("name")).alias("names"))
    seen = (ballots.where(F.col("entry_id").isNotNull()).select("event_id", "round_id", "entry_id", "won", "is_bye")
            .join(prelims, ["event_id", "round_id"]).groupBy("event_id", "entry_id")
            .agg(F.count("won").cast("int").alias("scored"),
                 F.count_if(F.col("won").isNull() & F.col("is_bye")).cast("int").alias("byes"),
                 F.collect_set("name").alias("here")))
    none = F.array().cast("array<string>")
    out = (entries.select("event_id", "entry_id", "dropped").join(seen, ["event_id", "entry_id"], "left")
           .join(n, "event_id").fillna(0, ["scored", "byes"]))
    absent = F.array_except("names", F.coalesce("here", none))
    return (out.withColumn("missing", (F.col("n_prelims") - F.col("scored") - F.col("byes")).cast("int"))
            .where("missing > 0")
            .select("event_id", "entry_id", "dropped", "scored", "byes", F.size(absent).alias("absent"), "missing",
                    F.array_join(F.array_sort(absent), ",").alias("absent_rounds")))


def trace_entries(rows: DataFrame, records: DataFrame) -> DataFrame:
    """The sheet's record of a row beside the derived one.

    rows: tournament pair result; records: tournament pair wins losses elim_level.
    """
    derived = F.concat_ws("-", F.col("wins").cast("string"), F.col("losses").cast("string"))
    return (rows.join(records, ["tournament", "pair"]).withColumn("derived", derived)
            .withColumn("differs", F.col("derived") != F.col("result"))
            .select("tournament", "pair", "result", "derived", "elim_level", "differs"))
