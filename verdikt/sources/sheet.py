"""Spreadsheet grids: (tab, row_idx, cells) to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verdikt.functions.text import norm_name, norm_num, pair_key, parse_record

# Column headings of the published tabs.
TOURNAMENT_COLUMNS = {
    "name": "Tournament", "start": "Start Date", "end": "End Date", "approval": "Approval",
    "category": "Category", "results": "Results", "open": "Open Field", "njv": "N/JV Field", "afs": "AFS",
    "elim": "Open Elim Field", "prelims": "Prelim #", "record": "Breaking Record",
    "prelim_adj": "Prelim Adjustment", "break_pct": "Break %", "break_penalty": "Break % Penalty",
    "toc": "TOC Qual",
}
ENTRY_COLUMNS = {
    "school1": "school 1", "school2": "school 2 (if hybrid)", "partner1": "partner 1", "partner2": "partner 2",
    "tournament": "tournament", "result": "result", "afs": "AFS", "base": "base_points",
    "walkover": "walkover_adjustment", "adj": "prelim/break percentage adj", "manual": "manual_adj",
    "calc": "calc_points", "hybrid": "hybrid", "size": "Incorrect Team Size?", "toc": "toc_qual",
}
TEAM_COLUMNS = {"rank": "Rank", "school": "School", "region": "Region", "debater1": "Debater 1",
                "debater2": "Debater 2", "points": "Points"}
SCHOOL_COLUMNS = {"rank": "Rank", "school": "School", "points": "Points"}
HEADER_ROWS = 5


def grid_to_table(grid: DataFrame, columns: dict[str, str], keys: tuple = ("tab",)) -> DataFrame:
    """Named text columns of every row under its tab's header.

    The header is the first of the top rows with two or more filled cells that
    are not all column letters; of repeated headings the first counts. A
    heading that is missing is an error.
    """
    keys = list(keys)
    filled = F.filter("cells", lambda c: F.coalesce(c, F.lit("")) != "")
    ruler = F.forall(filled, lambda c: c.rlike("^[A-Z]{1,2}$"))
    top = grid.where(F.col("row_idx") < HEADER_ROWS)
    found = (top.groupBy(*keys)
             .agg(F.min_by("cells", "row_idx").alias("_first"), F.min("row_idx").alias("_at0"),
                  F.min_by("cells", F.when(~ruler & (F.size(filled) > 1), F.col("row_idx"))).alias("_header"),
                  F.min(F.when(~ruler & (F.size(filled) > 1), F.col("row_idx"))).alias("_at")))
    heads = found.select(*keys, F.coalesce("_header", "_first").alias("_h"), F.coalesce("_at", "_at0").alias("_at"))
    places = {n: F.array_position("_h", h) for n, h in columns.items()}
    missing = F.concat_ws(", ", *[F.when(p == 0, F.lit(columns[n])) for n, p in places.items()])
    checked = heads.select(*keys, "_at", *[
        F.when(p == 0, F.raise_error(F.concat(F.lit("column not found: "), missing)).cast("int"))
        .otherwise(p.cast("int")).alias(f"_p_{n}") for n, p in places.items()])
    # One header row per tab: small beside the grid, whose rows stay where they are.
    return (grid.join(checked, keys).where(F.col("row_idx") > F.col("_at"))
            .select(*keys, "row_idx", *[
                F.coalesce(F.get("cells", F.col(f"_p_{n}") - 1), F.lit("")).alias(n) for n in columns]))


def _int(c: str) -> Column:
    return norm_num(F.regexp_replace(c, "[, ]", "")).cast("int")


def _pct(c: str) -> Column:
    return norm_num(F.regexp_extract(c, r"(-?[\d.]+)\s*%", 1))


def _true(c: str) -> Column:
    return F.upper(c) == "TRUE"


def official_tournaments(grid: DataFrame, keys: tuple = ("tab",)) -> DataFrame:
    t = grid_to_table(grid, TOURNAMENT_COLUMNS, keys).where("name <> ''")
    return t.select(
        *keys, "row_idx", "name", F.nullif(F.regexp_extract("results", r"tourn_id=(\d+)", 1), F.lit(""))
        .alias("tournament_id"), F.col("start").alias("start_date"), F.col("end").alias("end_date"), "approval",
        "category", _int("open").alias("open_field"), _int("njv").alias("njv_field"), _int("afs").alias("afs"),
        _int("elim").alias("open_elim_field"), _int("prelims").alias("prelim_count"),
        F.col("record").alias("breaking_record"), parse_record("record", 1).alias("breaking_wins"),
        parse_record("record", 2).alias("breaking_losses"), _int("prelim_adj").alias("prelim_adjustment"),
        _pct("break_pct").alias("break_pct"), _int("break_penalty").alias("break_penalty"),
        _true("toc").alias("toc_qual"))


def official_entries(grid: DataFrame, keys: tuple = ("tab",)) -> DataFrame:
    t = grid_to_table(grid, ENTRY_COLUMNS, keys).where("school1 <> ''")
    return t.select(
        *keys, "row_idx", "school1", "school2", "partner1", "partner2", "tournament", "result",
        _int("afs").alias("afs"), _int("base").alias("base_points"), _int("walkover").alias("walkover_adjustment"),
        _int("adj").alias("break_prelim_adjustment"), _int("manual").alias("manual_adjustment"),
        _int("calc").alias("calc_points"), _true("hybrid").alias("hybrid"), _true("size").alias("incorrect_team_size"),
        _true("toc").alias("toc_qual"))


def official_standings(grid: DataFrame, kind: str = "team", keys: tuple = ("tab",)) -> DataFrame:
    """Published standings; a row without a rank or points is skipped."""
    number = lambda c: norm_num(F.regexp_replace(c, ",", ""))
    t = grid_to_table(grid, TEAM_COLUMNS if kind == "team" else SCHOOL_COLUMNS, keys)
    t = (t.withColumn("rank", number("rank").cast("int")).withColumn("points", number("points"))
         .where((F.col("school") != "") & F.col("rank").isNotNull() & F.col("points").isNotNull()))
    if kind != "team":
        return t
    return (t.where("debater1 <> '' and debater2 <> ''")
            .withColumnsRenamed({"debater1": "partner1", "debater2": "partner2"})
            .withColumn("label", F.concat("school", F.lit(" "), "partner1", F.lit(" & "), "partner2")))


def tournaments_ahead(sheet: DataFrame, extra: DataFrame) -> DataFrame:
    """Adds tournaments named for the run that the sheet does not list, without published figures."""
    ahead = (extra.select("tournament_id").where("tournament_id <> ''").distinct()
             .join(sheet.select("tournament_id").where(F.col("tournament_id").isNotNull()), "tournament_id", "left_anti")
             .withColumn("name", F.lit("")).withColumn("category", F.lit("")).withColumn("row_idx", F.lit(-1)))
    return sheet.withColumn("ahead", F.lit(False)).unionByName(
        ahead.withColumn("ahead", F.lit(True)), allowMissingColumns=True)


def manual_results(df: DataFrame) -> DataFrame:
    """Hand-entered results, keyed as the sheet's rows are. Read from the caller's own table:
    tournament school partner1 partner2 points source. The first of repeated rows counts."""
    keyed = df.withColumn("pair", pair_key("partner1", "partner2"))
    order = F.struct("school", norm_name("partner1"), "points", "source")
    return keyed.groupBy("tournament", "pair").agg(
        F.min_by(F.struct("points", "source"), order).alias("m")).select("tournament", "pair", "m.points", "m.source")
