"""Tournament payloads: one nested document each, flattened to typed tables.

Ids arrive as numbers or text and are read as text. A payload is exploded
early, and each table keeps only the branches it needs, so column pruning
reaches the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from verdikt.functions.rules import TEAM_SIZE, elim_level_from_sections
from verdikt.functions.text import classify_division, is_parli, norm_id, norm_num, round_kind

_SCORE = "struct<tag:string,value:string,id:string,speaker:string>"
_BALLOT = (f"struct<id:string,entry:string,side:string,judge:string,judge_person:string,judge_first:string,"
           f"judge_last:string,entry_code:string,entry_name:string,panel:string,scores:array<{_SCORE}>>")
_SECTION = f"struct<id:string,letter:string,flight:string,round:string,room:string,ballots:array<{_BALLOT}>>"
_ROUND = (f"struct<id:string,name:string,label:string,type:string,protocol_name:string,start_time:string,"
          f"flights:string,sections:array<{_SECTION}>>")
_RESULT = ("struct<entry:string,rank:string,place:string,percentile:string,round:string,"
           "values:array<struct<result_key:string,protocol:string,priority:string,value:string>>>")
_SET = (f"struct<label:string,tag:string,bracket:string,published:string,generated:string,"
        f"result_keys:array<struct<id:string,tag:string,description:string>>,results:array<{_RESULT}>>")
_EVENT = (f"struct<id:string,name:string,abbr:string,type:string,rounds:array<{_ROUND}>,"
          f"result_sets:array<{_SET}>>")
_ENTRY = ("struct<id:string,code:string,name:string,event:string,school:string,students:array<string>,"
          "hybrid:string,dropped:string,active:string>")
_SCHOOL = (f"struct<id:string,chapter:string,name:string,code:string,entries:array<{_ENTRY}>,"
           f"students:array<struct<id:string,chapter:string,first:string,last:string>>>")
PAYLOAD_SCHEMA = (f"id string, name string, webname string, start string, `end` string, city string, state string, "
                  f"country string, timezone string, categories array<struct<id:string,name:string,abbr:string,"
                  f"events:array<{_EVENT}>>>, schools array<{_SCHOOL}>")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; ``tournament_id`` is its id, or ``unknown``."""
    raw = spark.read.schema(PAYLOAD_SCHEMA).option("multiLine", True).json(path)
    return with_ids(raw)


def parse_payloads(df: DataFrame, body: str = "body") -> DataFrame:
    """Payloads held as text in a column, for bodies already in a table."""
    return with_ids(df.select(F.from_json(body, PAYLOAD_SCHEMA).alias("p")).select("p.*"))


def with_ids(raw: DataFrame) -> DataFrame:
    return raw.withColumn("tournament_id", F.coalesce(norm_id("id"), F.lit("unknown")))


def tournaments_from_payload(df: DataFrame) -> DataFrame:
    day = lambda c: F.substr(F.col(c), F.lit(1), F.lit(10)).try_cast("date")
    return df.select("tournament_id", F.coalesce("name", F.lit("")).alias("name"),
                     day("start").alias("starts_on"), day("end").alias("ends_on"))


def _events(df: DataFrame) -> DataFrame:
    return (df.select("tournament_id", F.posexplode("categories").alias("cat_pos", "cat"))
            .select("tournament_id", "cat_pos", F.posexplode("cat.events").alias("ev_pos", "ev"))
            .withColumn("event_id", norm_id("ev.id")).where(F.col("event_id").isNotNull()))


def events_from_payload(df: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """overrides: tournament_id event_id division"""
    out = _events(df).select("tournament_id", "event_id", F.coalesce("ev.name", F.lit("")).alias("name"),
                             F.col("ev.abbr").alias("abbr"))
    forced = None
    if overrides is not None:
        out = out.join(overrides.withColumnRenamed("division", "_forced"), ["tournament_id", "event_id"], "left")
        forced = F.col("_forced")
    return (out.withColumn("division", classify_division("name", "abbr", forced))
            .withColumn("is_parli", is_parli("name", "abbr")).drop("_forced"))


def entries_from_payload(df: DataFrame) -> DataFrame:
    """Entries under schools, keyed by the event they name; a later listing wins."""
    flat = (df.select("tournament_id", F.posexplode("schools").alias("s_pos", "s"))
            .select("tournament_id", "s_pos", norm_id("s.id").alias("school_id"),
                    F.col("s.name").alias("school_name"), F.posexplode("s.entries").alias("e_pos", "e"))
            .withColumn("event_id", norm_id("e.event")).withColumn("entry_id", norm_id("e.id"))
            .where(F.col("event_id").isNotNull() & F.col("entry_id").isNotNull()))
    students = F.filter(F.transform(F.coalesce("e.students", F.array().cast("array<string>")), norm_id),
                        lambda s: s.isNotNull())
    row = F.struct(F.col("e.code").alias("code"), F.col("e.name").alias("name"), "school_id", "school_name",
                   students.alias("student_ids"), (F.size(students) == TEAM_SIZE).alias("eligible_team_size"),
                   (F.col("e.hybrid").isNotNull() & (F.col("e.hybrid") != "0")).alias("hybrid"),
                   F.coalesce(F.col("e.dropped") == "1", F.lit(False)).alias("dropped"))
    return (flat.groupBy("tournament_id", "event_id", "entry_id")
            .agg(F.max_by(row, F.struct("s_pos", "e_pos")).alias("r"))
            .select("tournament_id", "event_id", "entry_id", "r.*"))


def _rounds(df: DataFrame) -> DataFrame:
    return (_events(df).select("tournament_id", "event_id", F.posexplode("ev.rounds").alias("round_pos", "r")))


def rounds_from_payload(df: DataFrame) -> DataFrame:
    kind = round_kind("r.type")
    n = F.when(F.col("r.sections").isNull(), 0).otherwise(F.size("r.sections"))
    return _rounds(df).select(
        "tournament_id", "event_id", norm_id("r.id").alias("round_id"), "round_pos",
        F.coalesce("r.name", F.lit("")).alias("name"), F.trim(F.coalesce("r.label", F.lit(""))).alias("label"),
        F.coalesce("r.type", F.lit("")).alias("type"), kind.alias("kind"),
        (kind == "prelim").alias("is_prelim"), (kind == "elim").alias("is_elim"), n.alias("section_count"),
        F.when(kind == "elim", elim_level_from_sections(n)).alias("elim_level"))


def _outcome(ballot: Column) -> Column:
    """Whether a ballot's first win/loss score is a win; null without a usable one."""
    scores = F.coalesce(ballot["scores"], F.array().cast(f"array<{_SCORE}>"))
    first = F.get(F.filter(scores, lambda s: (s["tag"] == "winloss") & s["value"].isNotNull()), F.lit(0))
    return norm_num(first["value"]) >= 1


def _section_rows(df: DataFrame) -> DataFrame:
    return _rounds(df).select("tournament_id", "event_id", norm_id("r.id").alias("round_id"), "round_pos",
                              F.posexplode("r.sections").alias("section_pos", "s"))


def _ballot_rows(df: DataFrame) -> DataFrame:
    return (_section_rows(df).select("tournament_id", "event_id", "round_id", "round_pos", "section_pos",
                                     norm_id("s.id").alias("section_id"), F.posexplode("s.ballots").alias("ballot_pos", "b")))


def ballots_from_payload(df: DataFrame) -> DataFrame:
    """One row per judge per entry. A section with one entry is a bye; ``unscored`` means no ballot of it has a result.

    Both are read off the section's own list before it is taken apart, so nothing is joined or shuffled.
    """
    entries = F.array_distinct(F.array_compact(F.transform("s.ballots", lambda b: norm_id(b["entry"]))))
    decided = F.exists("s.ballots", lambda b: _outcome(b).isNotNull())
    return (_section_rows(df).select("tournament_id", "event_id", "round_id", "round_pos", "section_pos", norm_id("s.id").alias("section_id"),
                                     (F.size(entries) == 1).alias("is_bye"), (~F.coalesce(decided, F.lit(False))).alias("unscored"),
                                     F.posexplode("s.ballots").alias("ballot_pos", "b"))
            .select("tournament_id", "event_id", "round_id", "round_pos", "section_pos", "section_id", "ballot_pos",
                    norm_id("b.id").alias("ballot_id"), norm_id("b.entry").alias("entry_id"),
                    F.col("b.entry_code").alias("entry_code"), F.col("b.entry_name").alias("entry_name"),
                    norm_num("b.side").cast("int").alias("side"), norm_id("b.judge").alias("judge_id"),
                    norm_id("b.judge_person").alias("judge_person_id"), F.col("b.judge_first").alias("judge_first"),
                    F.col("b.judge_last").alias("judge_last"), _outcome(F.col("b")).alias("won"), "is_bye", "unscored"))


def speaker_scores_from_payload(df: DataFrame) -> DataFrame:
    """Numeric speaker points; the id is the ballot's and the place among its usable points."""
    points = F.filter(F.transform(
        F.filter(F.coalesce("b.scores", F.array().cast(f"array<{_SCORE}>")), lambda s: s["tag"] == "point"),
        lambda s: F.struct(norm_id(s["speaker"]).alias("debater_id"), norm_num(s["value"]).alias("raw"))),
        lambda p: p["raw"].isNotNull())
    return (_ballot_rows(df).select("tournament_id", "event_id", norm_id("b.id").alias("ballot_id"),
                                    norm_id("b.judge_person").alias("judge_id"), F.posexplode(points).alias("i", "p"))
            .select("tournament_id", "event_id", F.concat_ws("_", "ballot_id", "i").alias("score_id"), "ballot_id",
                    "p.debater_id", "judge_id", "p.raw"))


def adopt_ballot_only_entries(entries: DataFrame, ballots: DataFrame) -> DataFrame:
    """Adds entries seen only on ballots: no school, no people, not an eligible size."""
    keys = ["tournament_id", "event_id", "entry_id"]
    first = F.struct("round_pos", "section_pos", "ballot_pos")
    found = (ballots.where(F.col("entry_id").isNotNull()).join(entries.select(*keys), keys, "left_anti")
             .groupBy(*keys).agg(F.min_by(F.struct("entry_code", "entry_name"), first).alias("b"))
             .select(*keys, F.col("b.entry_code").alias("code"), F.col("b.entry_name").alias("name"),
                     F.lit(None).cast("string").alias("school_id"), F.lit(None).cast("string").alias("school_name"),
                     F.array().cast("array<string>").alias("student_ids"), F.lit(False).alias("eligible_team_size"),
                     F.lit(False).alias("hybrid"), F.lit(False).alias("dropped")))
    return entries.unionByName(found)


def _result_sets(df: DataFrame) -> DataFrame:
    return _events(df).select("tournament_id", "event_id", F.posexplode("ev.result_sets").alias("set_pos", "rs"))


def _results(df: DataFrame) -> DataFrame:
    return (_result_sets(df).select("tournament_id", "event_id", "set_pos", "rs",
                                    F.posexplode("rs.results").alias("res_pos", "res"))
            .withColumn("entry_id", norm_id("res.entry")).where(F.col("entry_id").isNotNull()))


def _key_id(*tags: str) -> Column:
    hit = F.filter(F.coalesce(F.col("rs.result_keys"), F.array().cast(
        "array<struct<id:string,tag:string,description:string>>")), lambda k: k["tag"].isin(*tags))
    return norm_id(F.get(hit, F.lit(0))["id"])


def _value(key: Column) -> Column:
    empty = F.array().cast("array<struct<result_key:string,protocol:string,priority:string,value:string>>")
    return F.get(F.filter(F.coalesce(F.col("res.values"), empty),
                          lambda v: norm_id(v["result_key"]) == key), F.lit(0))["value"]


_KEYS = ["tournament_id", "event_id", "entry_id"]


def _record() -> Column:
    """A per-round summary (``R1 W | R2 BYE``) as wins, losses and rounds, a bye a win; else a bare win total of zero rounds."""
    tokens = F.transform(F.regexp_extract_all(_value(_key_id("Ballots")), F.lit(r"(?i)R\d+\s+(BYE|W|L)\b"), F.lit(1)), F.upper)
    bare = norm_num(_value(_key_id("Win", "WinPm")))
    made = lambda w, l, n: F.struct(w.cast("int").alias("rec_wins"), l.cast("int").alias("rec_losses"), n.cast("int").alias("rec_rounds"))
    lost = F.size(F.filter(tokens, lambda t: t == "L"))
    return F.when(F.size(tokens) > 0, made(F.size(tokens) - lost, lost, F.size(tokens))).when(
        bare.isNotNull(), made(bare, F.lit(0), F.lit(0)))


def _said(df: DataFrame) -> DataFrame:
    """Each published result row with what it says: null where its set says nothing of the kind."""
    tag, place = F.col("rs.tag"), F.trim(F.coalesce("res.place", F.lit("")))
    seeds = F.coalesce("rs.label", tag, F.lit("")).rlike(r"(?i)prelim\s*seed")
    return _results(df).select(
        *_KEYS, F.struct("set_pos", "res_pos").alias("at"),
        F.when(tag == "seed", norm_num(_value(_key_id("WinPm")))).alias("prelim_wins"),
        F.when(tag == "seed", norm_num(_value(_key_id("BalPm")))).alias("prelim_ballots"),
        F.when(tag.isin("final", "seed"), _record()).alias("rec"),
        F.when(seeds, norm_num("res.rank")).cast("int").alias("seed"),
        F.when((tag == "final") & place.rlike("(?i)^(1st|1|first|champion|co-?champ)"), True).alias("champion"))


def _latest(name: str) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("at"))).alias(name)


def published_prelim_totals(df: DataFrame, tag: str) -> DataFrame:
    """Totals the tabulators published under ``tag`` (``WinPm`` or ``BalPm``) in a seed set; a later row wins."""
    name = {"WinPm": "prelim_wins", "BalPm": "prelim_ballots"}[tag]
    return _said(df).where(F.col(name).isNotNull()).groupBy(*_KEYS).agg(_latest(name)).withColumnRenamed(name, "total")


def published_records(df: DataFrame) -> DataFrame:
    """Records of final and seed sets; the first set that says anything about an entry is used."""
    return (_said(df).where(F.col("rec").isNotNull()).groupBy(*_KEYS).agg(F.min_by("rec", "at").alias("rec"))
            .select(*_KEYS, "rec.*"))


def prelim_seeds(df: DataFrame) -> DataFrame:
    return _said(df).where(F.col("seed").isNotNull()).groupBy(*_KEYS).agg(_latest("seed"))


def final_places_champions(df: DataFrame) -> DataFrame:
    return _said(df).where("champion").select(*_KEYS).distinct()


def published_from_payload(df: DataFrame) -> DataFrame:
    """Everything the tabulators published about an entry, one row each, from one pass over the result sets."""
    parts = ["prelim_wins", "prelim_ballots", "rec", "seed", "champion"]
    return (_said(df).where(F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in parts])).groupBy(*_KEYS)
            .agg(_latest("prelim_wins"), _latest("prelim_ballots"), F.min_by("rec", F.when(F.col("rec").isNotNull(), F.col("at"))).alias("rec"),
                 _latest("seed"), F.coalesce(F.bool_or("champion"), F.lit(False)).alias("champion"))
            .select(*_KEYS, "prelim_wins", "prelim_ballots", "rec.*", "seed", "champion"))


def student_index(df: DataFrame) -> DataFrame:
    """Student id to name; a later listing wins."""
    flat = (df.select("tournament_id", F.posexplode("schools").alias("s_pos", "s"))
            .select("tournament_id", "s_pos", F.posexplode("s.students").alias("p_pos", "p"))
            .withColumn("student_id", norm_id("p.id")).where(F.col("student_id").isNotNull()))
    name = F.struct(F.coalesce("p.first", F.lit("")).alias("first"), F.coalesce("p.last", F.lit("")).alias("last"))
    return (flat.groupBy("tournament_id", "student_id").agg(F.max_by(name, F.struct("s_pos", "p_pos")).alias("n"))
            .select("tournament_id", "student_id", "n.*"))


def dedupe_first(df: DataFrame, key: list[str], order: list[str], fill: list[str] | None = None) -> DataFrame:
    """First-seen row per key; columns in ``fill`` take the first value that is not null."""
    at = F.struct(*order)
    rest = [c for c in df.columns if c not in key]
    picks = [F.min_by(F.struct(c), F.when(F.col(c).isNotNull(), at) if c in (fill or []) else at)
             .getField(c).alias(c) for c in rest]
    return df.groupBy(*key).agg(*picks).select(*df.columns)
