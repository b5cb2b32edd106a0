"""Which payloads to read again, what changed in them, and published rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Where a rule document states each table, and where the statement ends.
RULE_SECTIONS = {
    "prelim": ("shall receive points based on their prelim record as follows:", r"(?m)XXI\.\d|^B\. Points Floor"),
    "league": ("Only the following records shall count for points:", r"(?m)^C\. |XXI\.\d"),
}
RULE_LINE = r"(?im)^\s*(\d+-\d+)\s*=\s*(\d+)\s*points?\s*$"
WINDOW_DAYS = 45


def sheet_date(c: Column | str) -> Column:
    """``MM/DD/YY`` or ``MM/DD/YYYY``; anything else is null."""
    text, pattern = F.trim(c), r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$"
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("int")
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    iso = F.format_string("%04d-%02d-%02d", year, part(1), part(2))
    return F.when(text.rlike(pattern), iso.try_cast("date"))


def refresh_due(tournaments: DataFrame, cached: DataFrame, today: Column, window: int = WINDOW_DAYS) -> DataFrame:
    """Adds ``due``: not cached, no usable date, or ended within the window.

    tournaments: tournament_id start_date end_date, as the sheet writes them.
    """
    held = cached.select("tournament_id").distinct().withColumn("_held", F.lit(True))
    ended = F.coalesce(sheet_date("end_date"), sheet_date("start_date"))
    due = F.col("_held").isNull() | ended.isNull() | (F.datediff(today, ended) <= window)
    return tournaments.join(held, "tournament_id", "left").withColumn("due", due).drop("_held")


def payload_changes(new: DataFrame, cached: DataFrame) -> DataFrame:
    """new, changed, unchanged or empty, by content hash. Both: tournament_id body."""
    digest = lambda d, name: d.select("tournament_id", F.sha2("body", 256).alias(name), F.lit(True).alias(f"_{name}"))
    both = digest(new, "now").join(digest(cached, "was"), "tournament_id", "full_outer")
    status = (F.when(F.col("_now").isNull() | F.col("now").isNull(), "empty").when(F.col("_was").isNull(), "new")
              .when(F.col("now") == F.col("was"), "unchanged").otherwise("changed"))
    return both.select("tournament_id", status.alias("status"))


def published_rules(docs: DataFrame) -> DataFrame:
    """(season, section, record, points) stated by each document; a later line wins.
    docs: season_id text."""
    out = None
    for section, (heading, stop) in RULE_SECTIONS.items():
        at = F.instr("text", heading)
        rest = F.substr(F.col("text"), at + len(heading))
        body = F.element_at(F.split(rest, stop, 2), 1)
        # Line ends are removed with the match, so neighbouring lines do not share one.
        pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(RULE_LINE), F.lit(1)).alias("record"),
                             F.regexp_extract_all(body, F.lit(RULE_LINE), F.lit(2)).alias("points"))
        lines = (docs.where(at > 0).select("season_id", F.posexplode(pairs).alias("i", "p"))
                 .groupBy("season_id", F.lit(section).alias("section"), F.col("p.record").alias("record"))
                 .agg(F.max_by(F.col("p.points"), "i").cast("int").alias("points")))
        out = lines if out is None else out.unionByName(lines)
    return out


def published_rule_diff(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per record of either side: matches, differs, ours only, theirs only, or a table
    the document does not state, which is a failure. rules: season_id section record points."""
    said = published_rules(docs)
    asked = docs.select("season_id").distinct()
    stated = said.select("season_id", "section").distinct().withColumn("_stated", F.lit(True))
    ours = rules.join(asked, "season_id", "left_semi")
    both = (ours.withColumnRenamed("points", "ours")
            .join(said.withColumnRenamed("points", "published"), ["season_id", "section", "record"], "full_outer")
            .join(stated, ["season_id", "section"], "left"))
    status = (F.when(F.col("_stated").isNull(), "not found").when(F.col("ours").isNull(), "theirs only")
              .when(F.col("published").isNull(), "ours only")
              .when(F.col("ours") == F.col("published"), "matches").otherwise("differs"))
    return both.select("season_id", "section", "record", "ours", "published", status.alias("status"))
