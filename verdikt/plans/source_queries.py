"""Queries over readers, text functions, matching and identity.

Payloads, grids and pages are written out from the driver tables, one small
document per order or customer, and read back by the readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verdikt.functions import labels as L, seasons as SE, speaker_scale as SC, text as T
from verdikt.functions.rules import LEAGUE_POINTS, PRELIM_POINTS
from verdikt.operators import cases as C, graph as GR, identity as I, matching as M
from verdikt.plans.driver_tables import DriverTables, loaded_as
from verdikt.plans.registry import CTES, query
from verdikt.plans.scoring_queries import field_table, performance
from verdikt.sources import calendar as CAL, payload as P, refresh as RF, sheet as SH

_s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def payloads(t: DriverTables) -> DataFrame:
    """One document a room with every branch the readers use, parsed once and kept as columns, as the load does.

    A document holds at most a hundred lines of its room; a longer room is several documents, which repeat its entries.
    """
    def build() -> DataFrame:
        def ballot(side: int, l: Column) -> Column:
            said = F.when(l["flag"] != "N", _s((l["flag"] == ("A" if side == 1 else "R")).cast("int")))
            return F.struct(
                F.concat_ws("-", "section_id", l["line"].cast("string"), l["part"].cast("string"), F.lit(str(side))).alias("id"),
                _s(f"s{side}").alias("entry"), F.lit(str(side)).alias("side"), _s(l["part"] % 200).alias("judge_person"),
                F.concat(F.lit("E"), _s(f"s{side}")).alias("entry_code"),
                F.array(F.struct(F.lit("winloss").alias("tag"), said.alias("value"), F.lit(None).cast("string").alias("speaker")),
                        F.struct(F.lit("point").alias("tag"), F.when(l["line"] % 5 == 0, F.lit("n/a")).otherwise(_s(l["qty"])).alias("value"),
                                 _s(l["supp"]).alias("speaker"))).alias("scores"))
        one, two = F.transform("ls", lambda l: ballot(1, l)), F.transform("ls", lambda l: ballot(2, l))
        ballots = F.when(F.col("s1") == F.col("s2"), one).otherwise(F.concat(one, two))
        section = F.struct(F.col("section_id").alias("id"), ballots.alias("ballots"))
        rnd = F.struct(F.col("round_id").alias("id"), "name", F.when(F.col("kind") == "prelim", "highhigh").otherwise("elim").alias("type"),
                       F.array(section).alias("sections"))
        val = lambda k, v: F.struct(F.lit(k).alias("result_key"), v.alias("value"))
        res = lambda e, rank, place, text: F.struct(
            _s(e).alias("entry"), F.lit(rank).alias("rank"), F.lit(place).alias("place"),
            F.array(val("1", _s(F.col("k") % 4)), val("2", F.lit(text))).alias("values"))
        keys = F.array(F.struct(F.lit("1").alias("id"), F.lit("WinPm").alias("tag")), F.struct(F.lit("2").alias("id"), F.lit("Ballots").alias("tag")))
        one_set = lambda tag, label, *r: F.struct(F.lit(tag).alias("tag"), F.lit(label).alias("label"), keys.alias("result_keys"), F.array(*r).alias("results"))
        sets = F.array(one_set("seed", "Prelim Seeds", res("s1", "1", "", "R1   W | R2  BYE | R3 L"), res("s2", "2", "", "none")),
                       one_set("final", "Final Places", res("s1", "1", "Co-Champion", "none")))
        event = F.struct(F.col("section_id").alias("id"), F.lit("Open Parli").alias("name"), F.lit("OPEN").alias("abbr"),
                         F.array(rnd).alias("rounds"), sets.alias("result_sets"))
        student = lambda c, n: F.struct(_s(c).alias("id"), F.lit(n).alias("first"), F.concat(F.lit("L"), _s(c)).alias("last"))
        entry = F.struct(_s("s1").alias("id"), F.concat(F.lit("E"), _s("s1")).alias("code"), F.col("section_id").alias("event"),
                         F.array(_s("s1"), _s("s2")).alias("students"), _s(F.col("k") % 2).alias("hybrid"), _s((F.col("k") % 7 == 0).cast("int")).alias("dropped"))
        school = F.struct(_s(F.col("s1") % 25).alias("id"), F.concat(F.lit("School "), _s(F.col("s1") % 25)).alias("name"), F.array(entry).alias("entries"),
                          F.array(student("s1", "A"), student("s2", "B")).alias("students"))
        room = ["k", "tournament_id", "section_id", "round_id", "name", "kind", "s1", "s2"]
        rooms = t.room_lines.groupBy(*room, F.floor((F.col("l.line") - 1) / 100).alias("sheet")).agg(F.array_sort(F.collect_list("l")).alias("ls"))
        return P.parse_payloads(rooms.select(F.to_json(F.struct(
            F.col("section_id").alias("id"), F.col("tournament_id").alias("name"), F.concat("tournament_id", F.lit(" 08:00:00")).alias("start"),
            F.array(F.struct(F.array(event).alias("events"))).alias("categories"), F.array(school).alias("schools"))).alias("body")))
    return loaded_as(t, "payloads", build)


@query("payload_ballots", """
SELECT r.section_id AS tournament_id, r.section_id AS event_id, r.round_id, CAST(CASE WHEN z.side = 1 THEN r.s1 ELSE r.s2 END AS VARCHAR) AS entry_id, CAST(z.side AS INTEGER) AS side, count(*) AS ballots,
  count(*) FILTER (WHERE (z.side = 1 AND l_returnflag = 'A') OR (z.side = 2 AND l_returnflag = 'R')) AS won, count(*) FILTER (WHERE l_returnflag <> 'N') AS decided, r.s1 = r.s2 AS is_bye, count(*) FILTER (WHERE l_returnflag <> 'N') = 0 AS unscored
FROM rooms AS r JOIN lineitem AS l ON l.l_orderkey = r.k JOIN (VALUES (1), (2)) AS z(side) ON z.side = 1 OR r.s1 <> r.s2 GROUP BY ALL""")
def payload_ballots(t):
    b = P.ballots_from_payload(payloads(t))
    return b.groupBy("tournament_id", "event_id", "round_id", "entry_id", "side", "is_bye", "unscored").agg(
        F.count("*").alias("ballots"), F.count_if("won").alias("won"), F.count("won").alias("decided"))


@query("payload_entries", """
SELECT section_id AS event_id, CAST(s1 AS VARCHAR) AS entry_id, 'E' || CAST(s1 AS VARCHAR) AS code, CAST(s1 % 25 AS VARCHAR) AS school_id, TRUE AS eligible_team_size, k % 2 <> 0 AS hybrid, k % 7 = 0 AS dropped FROM rooms
UNION ALL SELECT section_id, CAST(s2 AS VARCHAR), 'E' || CAST(s2 AS VARCHAR), NULL, FALSE, FALSE, FALSE FROM rooms WHERE s1 <> s2""")
def payload_entries(t):
    p = payloads(t)
    return P.adopt_ballot_only_entries(P.entries_from_payload(p), P.ballots_from_payload(p)).select(
        "event_id", "entry_id", "code", "school_id", "eligible_team_size", "hybrid", "dropped")


@query("payload_scores", """
SELECT r.section_id AS event_id, CAST(l_suppkey AS VARCHAR) AS debater_id, count(*) * CASE WHEN r.s1 = r.s2 THEN 1 ELSE 2 END AS n, sum(l_quantity) * CASE WHEN r.s1 = r.s2 THEN 1 ELSE 2 END AS raw
FROM rooms AS r JOIN lineitem AS l ON l.l_orderkey = r.k WHERE l_linenumber % 5 <> 0 GROUP BY r.section_id, l_suppkey, r.s1, r.s2""")
def payload_scores(t):
    return P.speaker_scores_from_payload(payloads(t)).groupBy("event_id", "debater_id").agg(F.count("*").alias("n"), F.sum("raw").alias("raw"))


@query("payload_published", """
SELECT section_id AS event_id, CAST(s1 AS VARCHAR) AS entry_id, CAST(CASE WHEN s1 = s2 THEN k % 4 ELSE k % 4 END AS DOUBLE) AS prelim_wins, 2 AS rec_wins, 1 AS rec_losses, 3 AS rec_rounds, CASE WHEN s1 = s2 THEN 2 ELSE 1 END AS seed, TRUE AS champion FROM rooms
UNION ALL SELECT section_id, CAST(s2 AS VARCHAR), CAST(k % 4 AS DOUBLE), CAST(k % 4 AS INTEGER), 0, 0, 2, FALSE FROM rooms WHERE s1 <> s2""")
def payload_published(t):
    return P.published_from_payload(payloads(t)).select("event_id", "entry_id", "prelim_wins", "rec_wins", "rec_losses", "rec_rounds", "seed", "champion")


@query("payload_students", """
SELECT section_id AS tournament_id, CAST(s2 AS VARCHAR) AS student_id, 'B' AS first, 'L' || CAST(s2 AS VARCHAR) AS last FROM rooms
UNION ALL SELECT section_id, CAST(s1 AS VARCHAR), 'A', 'L' || CAST(s1 AS VARCHAR) FROM rooms WHERE s1 <> s2""")
def payload_students(t):
    return P.student_index(payloads(t))


@query("payload_shape", """
SELECT section_id AS event_id, 'open' AS division, TRUE AS is_parli, kind, CAST(1 AS INTEGER) AS section_count, CASE WHEN kind = 'elim' THEN 'first' END AS elim_level, starts_on FROM rooms""")
def payload_shape(t):
    p = payloads(t)
    return (P.events_from_payload(p).select("tournament_id", "event_id", "division", "is_parli")
            .join(P.rounds_from_payload(p).select("event_id", "kind", "section_count", "elim_level"), "event_id")
            .join(P.tournaments_from_payload(p).select("tournament_id", "starts_on"), "tournament_id").drop("tournament_id").distinct())


@query("first_seen", """
SELECT supp, arg_min(entry_id, entry_id) AS entry_id, arg_min(hybrid_school_id, entry_id) FILTER (WHERE hybrid_school_id IS NOT NULL) AS hybrid_school_id FROM entries GROUP BY supp""")
def first_seen(t):
    e = t.entries.select("supp", "entry_id", "hybrid_school_id").withColumn("seen", F.col("entry_id"))
    return P.dedupe_first(e, ["supp"], ["seen"], ["hybrid_school_id"]).drop("seen")


def _grid(rows: DataFrame, tab: str, columns: dict[str, str], values: dict[str, Column]) -> DataFrame:
    """A tab per value of ``tab``: a ruler row, the headings, then a row per order."""
    heads = F.array(*[F.lit(h) for h in columns.values()])
    ruler = F.array(*[F.lit(chr(65 + i % 26)) for i in range(len(columns))])
    tabs = rows.select(F.col(tab).alias("tab")).distinct()
    top = tabs.select("tab", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("row_idx"), ruler.alias("cells")),
                                               F.struct(F.lit(1).cast("long").alias("row_idx"), heads.alias("cells")))).alias("r")).select("tab", "r.*")
    cells = F.array(*[F.coalesce(values.get(n, F.lit("")).cast("string"), F.lit("")) for n in columns])
    return top.unionByName(rows.select(F.col(tab).alias("tab"), (F.col("o_orderkey") + 2).alias("row_idx"), cells.alias("cells")))


@query("grid_tournaments", """
SELECT o_orderstatus AS tab, o_orderkey + 2 AS row_idx, 'T' || CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) END AS tournament_id, CASE WHEN o_custkey % 4 <> 0 THEN CAST(1000 + o_custkey AS INTEGER) END AS open_field,
  CAST(o_custkey % 9 AS INTEGER) AS breaking_wins, CAST(o_orderkey % 4 AS INTEGER) AS breaking_losses, CAST(o_custkey % 50 AS DOUBLE) + 0.5 AS break_pct, o_orderkey % 2 = 0 AS toc_qual FROM orders WHERE o_orderkey % 10 <> 9""")
def grid_tournaments(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    values = {"name": F.when(k % 10 != 9, F.concat(F.lit("T"), _s(k))), "results": F.when(k % 3 == 0, F.concat(F.lit("/index.mhtml?tourn_id="), _s(c), F.lit("&x"))),
              "open": F.when(c % 4 != 0, F.format_number(1000 + c, 0)), "record": F.concat(_s(c % 9), F.lit(" - "), _s(k % 4)),
              "break_pct": F.concat(_s(c % 50), F.lit(".5 %")), "toc": F.when(k % 2 == 0, "true").otherwise("FALSE")}
    return SH.official_tournaments(_grid(t.raw("orders"), "o_orderstatus", SH.TOURNAMENT_COLUMNS, values)).select(
        "tab", "row_idx", "name", "tournament_id", "open_field", "breaking_wins", "breaking_losses", "break_pct", "toc_qual")


@query("grid_entries", """
SELECT o_orderstatus AS tab, o_orderkey + 2 AS row_idx, 'S' || CAST(o_custkey % 25 AS VARCHAR) AS school1, 'P' || CAST(o_custkey AS VARCHAR) AS partner1, CAST(o_orderkey % 30 AS INTEGER) AS calc_points, CAST(-(o_orderkey % 4) AS INTEGER) AS walkover_adjustment, o_orderkey % 5 = 0 AS hybrid FROM orders""")
def grid_entries(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    values = {"school1": F.concat(F.lit("S"), _s(c % 25)), "partner1": F.concat(F.lit("P"), _s(c)), "calc": k % 30, "walkover": -(k % 4), "hybrid": F.upper(_s(k % 5 == 0))}
    return SH.official_entries(_grid(t.raw("orders"), "o_orderstatus", SH.ENTRY_COLUMNS, values)).select(
        "tab", "row_idx", "school1", "partner1", "calc_points", "walkover_adjustment", "hybrid")


@query("grid_standings", """
SELECT o_orderstatus AS tab, o_orderkey + 2 AS row_idx, CAST(o_orderkey AS INTEGER) AS rank, o_totalprice AS points, 'S P & Q' AS label FROM orders WHERE o_custkey % 6 <> 0""")
def grid_standings(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    values = {"rank": F.when(c % 6 != 0, k), "school": F.lit("S"), "debater1": F.lit("P"), "debater2": F.lit("Q"), "points": F.format_number("o_totalprice", 2)}
    return SH.official_standings(_grid(t.raw("orders"), "o_orderstatus", SH.TEAM_COLUMNS, values)).select("tab", "row_idx", "rank", "points", "label")


@query("calendar_rows", """
SELECT page_id, CAST(page_id AS VARCHAR) AS tournament_id, 'Cup & ' || CAST(o_custkey AS VARCHAR) AS name, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'City ' || CAST(o_custkey % 25 AS VARCHAR) END AS location, d AS starts_on,
  d + CASE WHEN o_custkey % 2 = 0 THEN 0 WHEN day(d) <= 20 THEN 2 ELSE 1 END::INTEGER AS ends_on, 'Novice,Open' AS events FROM (SELECT o_orderkey AS page_id, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders) AS o""")
def calendar_rows(t):
    day = F.to_date("o_orderdate")
    n = F.dayofmonth(day)
    last = F.when(n <= 20, n + 2).otherwise(1)
    span = F.when(F.col("o_custkey") % 2 == 0, _s(n)).otherwise(F.concat(_s(n), F.lit("&ndash;"), _s(last)))
    html = F.concat(
        F.lit('<table><tr class="h"><th>Name</th></tr><tr>\n<td class="x"><a class="f"\n href="/t?tourn_id='), _s("o_orderkey"), F.lit('"> Cup &amp; '), _s("o_custkey"),
        F.lit("\n</a></td><td>"), F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("City "), _s(F.col("o_custkey") % 25))),
        F.lit('</td><td data-text="'), F.date_format(day, "yyyy-MM-dd"), F.lit(' 08:00:00">'), F.date_format(day, "EEE MMM "), span, F.lit(", "), F.date_format(day, "yyyy"),
        F.lit('</td><td>Novice, Open</td><td data-text="2020-01-01 00:00:00">x</td></tr></table>'))
    pages = t.raw("orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_custkey"), html.alias("html"))
    return CAL.calendar_rows(pages.select("page_id", "html")).drop("row_pos").withColumn("events", F.array_join("events", ","))


@query("pages_without_calendar", "SELECT count(*) AS pages, 0::BIGINT AS listed FROM pages")
def pages_without_calendar(t):
    """The given pages are no calendars: none may yield a row."""
    p = t.raw("pages").select("page_id", "html")
    found = CAL.calendar_rows(p, must_find=False).select("page_id").distinct().withColumn("hit", F.lit(1))
    return p.join(found, "page_id", "left").agg(F.count("*").alias("pages"), F.count("hit").alias("listed"))


@query("worth_fetching", """
SELECT kind, advertises, worth, count(*) AS parts FROM (SELECT CAST(p_partkey % 6 AS INTEGER) AS kind, p_partkey % 6 IN (0, 1, 3) AS advertises, p_partkey % 6 <> 2 AS worth FROM part) AS x GROUP BY ALL""")
def worth_fetching(t):
    lists = F.array(*[F.array(*map(F.lit, e)) for e in (["Open Parli", "LD"], ["PAR"], ["VLD", "CX"], ["NPDA"], ["Chess"], [""])])
    x = t.raw("part").select((F.col("p_partkey") % 6).cast("int").alias("kind")).withColumn("events", F.get(lists, F.col("kind")))
    return x.select("kind", CAL.advertises_parli("events").alias("advertises"), CAL.worth_fetching("events").alias("worth")).groupBy(
        "kind", "advertises", "worth").agg(F.count("*").alias("parts"))


@query("refresh_due", """
SELECT CAST(o_orderkey AS VARCHAR) AS tournament_id, o_orderkey % 3 = 0 OR o_orderkey % 11 = 0 OR CAST(DATE '1998-06-30' - CAST(o_orderdate AS DATE) AS INTEGER) <= 45 AS due FROM orders""")
def refresh_due(t):
    k = F.col("o_orderkey")
    sheet = t.raw("orders").select(
        _s(k).alias("tournament_id"),
        F.when(k % 11 == 0, "soon").when(k % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise("").alias("end_date"),
        F.when(k % 11 == 0, "").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("start_date"))
    cached = t.raw("orders").where(k % 3 != 0).select(_s(k).alias("tournament_id"))
    return RF.refresh_due(sheet, cached, F.lit("1998-06-30").cast("date")).select("tournament_id", "due")


@query("payload_changes", """
SELECT status, count(*) AS payloads FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'empty' WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM orders
  WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 3 = 0)) AS x GROUP BY ALL""")
def payload_changes(t):
    k = F.col("o_orderkey")
    base = t.raw("orders").select(k, _s(k).alias("tournament_id"), F.concat_ws("|", _s("o_custkey"), _s("o_totalprice")).alias("body"))
    new = base.where(k % 5 != 0)
    cached = base.where(k % 3 != 0).withColumn("body", F.when(k % 7 == 0, F.concat("body", F.lit("old"))).otherwise(F.col("body")))
    return RF.payload_changes(new, cached).groupBy("status").agg(F.count("*").alias("payloads"))


@query("rule_diff", """
SELECT status, count(*) AS records FROM (
  SELECT CASE WHEN c_custkey % 4 = 3 AND sec = 'league' THEN 'not found' WHEN rec = '2-1' AND c_custkey % 4 = 1 THEN 'differs' WHEN rec = '3-0' AND c_custkey % 4 = 2 THEN 'ours only' ELSE 'matches' END AS status
  FROM customer, (VALUES ('prelim', '2-1'), ('prelim', '3-0'), ('prelim', '3-1'), ('prelim', '4-0'), ('prelim', '3-2'), ('prelim', '4-1'), ('prelim', '5-0'), ('prelim', '4-2'), ('prelim', '5-1'), ('prelim', '6-0'),
    ('league', '2-1'), ('league', '3-0'), ('league', '3-1'), ('league', '4-0')) AS v(sec, rec)) AS x GROUP BY ALL""")
def rule_diff(t):
    c = F.col("c_custkey")

    def lines(table: dict[str, int]) -> Column:
        each = [F.when((F.lit(r == "3-0")) & (c % 4 == 2), "").otherwise(F.concat(
            F.lit(f"\n  {r} = "), _s(F.lit(p) + F.when(F.lit(r == "2-1") & (c % 4 == 1), 1).otherwise(0)), F.lit(" points"))) for r, p in table.items()]
        return F.concat(*each)
    text = F.concat(F.lit("Intro\nshall receive points based on their prelim record as follows:"), lines(PRELIM_POINTS), F.lit("\nB. Points Floor\n 9-9 = 1 points\n"),
                    F.when(c % 4 == 3, "").otherwise(F.concat(F.lit("Only the following records shall count for points:"), lines(LEAGUE_POINTS), F.lit("\nC. Next\n"))))
    docs = t.raw("customer").select(_s(c).alias("season_id"), text.alias("text"))
    record = [F.struct(F.lit(s).alias("section"), F.lit(r).alias("record"), F.lit(p).alias("points"))
              for s, table in (("prelim", PRELIM_POINTS), ("league", LEAGUE_POINTS)) for r, p in table.items()]
    rules = docs.select("season_id", F.explode(F.array(*record)).alias("r")).select("season_id", "r.*")
    return RF.published_rule_diff(docs, rules).groupBy("status").agg(F.count("*").alias("records"))


@query("tournaments_ahead", """
SELECT CAST(o_orderkey AS VARCHAR) AS tournament_id, FALSE AS ahead FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), TRUE FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 6 = 0""")
def tournaments_ahead(t):
    k = F.col("o_orderkey")
    sheet = t.raw("orders").where(k % 4 != 0).select(_s(k).alias("tournament_id"), F.lit("x").alias("name"), F.lit("c").alias("category"), k.cast("int").alias("row_idx"))
    return SH.tournaments_ahead(sheet, t.raw("orders").where(k % 6 == 0).select(_s(k).alias("tournament_id"))).select("tournament_id", "ahead")


@query("calendar_lookahead", "SELECT CAST(o_orderkey AS VARCHAR) AS tournament_id FROM orders WHERE o_orderkey % 5 = 1 AND o_orderkey % 2 <> 0")
def calendar_lookahead(t):
    k = F.col("o_orderkey")
    rows = t.raw("orders").select(k, _s(k).alias("tournament_id"))
    return CAL.calendar_lookahead(rows.where(k % 5 == 1).select("tournament_id"), rows.where(k % 2 == 0).select("tournament_id"))


@query("season_of_date", """
SELECT season_id, starts_on, ends_on, status, count(*) AS orders FROM (SELECT *, make_date(y, 8, 1) AS starts_on, make_date(y + 1, 7, 31) AS ends_on, CASE WHEN DATE '1998-03-01' < make_date(y, 8, 1) THEN 'upcoming' WHEN DATE '1998-03-01' > make_date(y + 1, 7, 31) THEN 'final' ELSE 'live' END AS status
  FROM (SELECT y, CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season_id FROM (SELECT CAST(year(o_orderdate) AS INTEGER) - CASE WHEN month(o_orderdate) >= 8 THEN 0 ELSE 1 END AS y FROM orders) AS a) AS b) AS c GROUP BY ALL""")
def season_of_date(t):
    s = t.raw("orders").select(SE.season_of(F.to_date("o_orderdate")).alias("season_id"))
    return s.select("season_id", SE.season_window("season_id").alias("w"), SE.season_status("season_id", F.lit("1998-03-01").cast("date")).alias("status")).where(
        SE.is_season_id("season_id")).groupBy("season_id", "w.starts_on", "w.ends_on", "status").agg(F.count("*").alias("orders"))


@query("text_keys", """
SELECT c_custkey, 'stlan' || n AS school, 'elan' || n AS letters, 'elan' || n AS plain, least('elan' || n, 'zeta') || '|' || greatest('elan' || n, 'zeta') AS pair FROM (
  SELECT c_custkey, chr(97 + CAST(c_custkey % 26 AS INTEGER)) AS n FROM customer) AS c""")
def text_keys(t):
    n = F.char(97 + (F.col("c_custkey") % 26).cast("int"))
    c = t.raw("customer").select("c_custkey", F.concat(F.lit("St. Lán"), n, F.lit(" High School / Other")).alias("s"), F.concat(F.lit("Élan-"), n).alias("l"), F.concat(F.lit("x. Élan"), n).alias("p"))
    return c.select("c_custkey", T.school_key("s").alias("school"), T.letters("l").alias("letters"), T.norm_name("p").alias("plain"), T.pair_key("p", F.lit("Z. Zeta")).alias("pair"))


@query("divisions", """
SELECT division, is_parli, kind, count(*) AS parts FROM (SELECT list_extract(['novice', 'jv', 'middle', 'open', 'open', 'unknown', 'unknown'], CAST(p_partkey % 7 + 1 AS INTEGER)) AS division, p_partkey % 7 IN (0, 1, 2, 3, 4) AS is_parli,
  list_extract(['prelim', 'elim', 'other'], CAST(p_size % 3 + 1 AS INTEGER)) AS kind FROM part) AS x GROUP BY ALL""")
def divisions(t):
    names = ["Novice Parli", "JV Parli", "Middle School Parli", "Varsity Parli", "Parliamentary", "Public Forum PAR", "Congress"]
    kinds = ["HighHigh", "runoff", "roundrobin"]
    pick = lambda v, i: F.get(F.array(*map(F.lit, v)), i.cast("int"))
    p = t.raw("part").select(pick(names, F.col("p_partkey") % 7).alias("name"), pick(kinds, F.col("p_size") % 3).alias("type"), F.lit(None).cast("string").alias("abbr"))
    return p.select(T.classify_division("name", "abbr").alias("division"), T.is_parli("name", "abbr").alias("is_parli"), T.round_kind("type").alias("kind")).groupBy(
        "division", "is_parli", "kind").agg(F.count("*").alias("parts"))


@query("claimed_events", """
SELECT owned, in_field, division, count(*) AS orders FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN o_custkey % 4 = 0 WHEN 1 THEN o_custkey % 4 = 1 ELSE o_custkey % 4 = 1 END AS owned, o_custkey % 4 = 1 AS in_field,
  CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 4 = 0 THEN 'open' WHEN o_custkey % 4 = 0 THEN 'unknown' WHEN o_custkey % 4 = 1 THEN 'open' WHEN o_custkey % 4 = 2 THEN 'novice' ELSE 'unknown' END AS division FROM orders) AS x GROUP BY ALL""")
def claimed_events(t):
    pick = lambda v, i: F.get(F.array(*map(F.lit, v)), i.cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    e = t.raw("orders").select(pick(["NPDL Round Robin", "NPDL Nationals", "Cup"], k % 3).alias("tournament"), pick(["The Round Robin", "Open Parli", "Novice Parli", "Chess"], c % 4).alias("name"),
                               F.lit(None).cast("string").alias("abbr"))
    e = e.withColumns({"division": T.classify_division("name", "abbr"), "is_parli": T.is_parli("name", "abbr")})
    owned = C.owned_events("tournament", "name", F.col("is_parli"), F.col("division"))
    field = C.field_events("tournament", "name", F.col("is_parli"), F.col("division"))
    return e.select(owned.alias("owned"), field.alias("in_field"), T.claimed_division(owned, F.col("is_parli"), F.col("division")).alias("division")).groupBy(
        "owned", "in_field", "division").agg(F.count("*").alias("orders"))


@query("score_scales", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s = 1 THEN 23.0 WHEN s = 2 THEN 0.0 ELSE 25.0 END AS lo, CASE WHEN s = 2 THEN 100.0 ELSE 30.0 END AS hi,
  round(CASE s WHEN 1 THEN 25 + (l_quantity - 23) * 5.0::DOUBLE / 7 WHEN 2 THEN 25 + l_quantity * 5.0::DOUBLE / 100 ELSE l_quantity END, 6) AS canonical,
  CASE WHEN s = 2 THEN NULL WHEN s = 1 AND (l_quantity < 16 OR l_quantity > 30.7) THEN 'out-of-range' WHEN s = 0 AND (l_quantity < 20 OR l_quantity > 30.5) THEN 'out-of-range' END AS reason FROM (SELECT *, l_partkey % 3 AS s FROM lineitem) AS l""")
def score_scales(t):
    name = F.get(F.array(F.lit("Cup"), F.lit("NYPDL Fall"), F.lit("YFL 1")), (F.col("l_partkey") % 3).cast("int"))
    x = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", SC.scale_for(name).alias("s"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "s.lo", "s.hi", F.round(SC.to_canonical("l_quantity", "s.lo", "s.hi"), 6).alias("canonical"),
                    SC.classify_raw("l_quantity", "s.lo", "s.hi").alias("reason"))


@query("walkover_directions", """
SELECT level, reached, direction, count(*) AS lines FROM (SELECT level, reached, CASE WHEN l_suppkey % 4 = 0 OR l_partkey % 2 <> l_suppkey % 2 OR NOT (l_linenumber < 4) THEN NULL WHEN level IS NULL OR reached IS NULL THEN 'unknown'
  WHEN list_position(o, reached) > list_position(o, level) THEN 'advanced' ELSE 'conceded' END AS direction FROM (
  SELECT *, ['octo', 'quarter', 'semi', 'first'] AS o, list_extract(['octo', 'quarter', 'semi', 'first', NULL], CAST(l_partkey % 5 + 1 AS INTEGER)) AS level, list_extract(['octo', 'quarter', 'semi', 'first', NULL], CAST(l_orderkey % 5 + 1 AS INTEGER)) AS reached FROM lineitem) AS x) AS y GROUP BY ALL""")
def walkover_directions(t):
    levels = F.array(*[F.lit(x) for x in ("octo", "quarter", "semi", "first", None)])
    x = t.raw("lineitem").select("l_suppkey", "l_partkey", "l_linenumber", F.get(levels, (F.col("l_partkey") % 5).cast("int")).alias("level"), F.get(levels, (F.col("l_orderkey") % 5).cast("int")).alias("reached"))
    d = L.walkover_direction(F.col("l_suppkey") % 4 == 0, F.lit("elim"), "level", F.lit("Regular"), _s(F.col("l_partkey") % 2), _s(F.col("l_suppkey") % 2), "l_linenumber", F.lit(4), "reached")
    return x.withColumn("direction", d).groupBy("level", "reached", "direction").agg(F.count("*").alias("lines"))


@query("sender_handles", "SELECT event_id, substr(sha256('salt:' || CASE WHEN user_id % 3 = 0 THEN 'unknown' ELSE '10.0.0.' || CAST(user_id AS VARCHAR) END), 1, 32) AS handle FROM events")
def sender_handles(t):
    ip = F.concat(F.lit("10.0.0."), _s("user_id"))
    return t.raw("events").select("event_id", T.sender_hash(F.when(F.col("user_id") % 3 == 1, F.concat(F.lit(" "), ip, F.lit(", 8.8.8.8"))), F.when(F.col("user_id") % 3 == 2, ip), F.lit("salt")).alias("handle"))


@query("fuzzy_names", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE ELSE FALSE END AS near, CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS INTEGER) AS within_one, CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS INTEGER) AS within_three FROM part""")
def fuzzy_names(t):
    k = F.col("p_partkey") % 4
    word = F.concat(F.lit("xy"), F.replace(F.col("p_name"), F.lit(" "), F.lit("")))
    other = (F.when(k == 0, word).when(k == 1, F.concat(F.lit("yx"), F.substr(word, F.lit(3))))
             .when(k == 2, F.concat(word, F.lit("q"))).otherwise(F.concat(F.lit("q"), word, F.lit("q"))))
    x = t.raw("part").select("p_partkey", word.alias("a"), other.alias("b"))
    return x.select("p_partkey", T.within_one_edit("a", "b").alias("near"), T.edit_distance_within("a", "b", 1).alias("within_one"), T.edit_distance_within("a", "b", 3).alias("within_three"))


def sheet_teams(t: DriverTables) -> tuple[DataFrame, DataFrame]:
    """Published rows and entries of small tournaments of customers: some misspelt, some alike."""
    c = F.col("c_custkey")
    who = lambda i: F.concat(F.lit("Qu"), F.char(97 + (i % 13).cast("int")), F.char(97 + (F.floor(i / 13) % 5).cast("int")), F.lit("en"))
    base = t.raw("customer").select(F.floor(c / 12).cast("string").alias("tournament"), c.cast("int").alias("row_idx"), _s(c).alias("entry_id"),
                                    F.concat(F.lit("Lincoln "), _s(F.floor(c / 4) % 3)).alias("school"), who(c % 7).alias("n1"), who(c % 5 + 13).alias("n2"), c.alias("c"))
    person = lambda n, f: F.struct(F.lit(f).alias("first"), F.col(n).alias("last"))
    cand = base.select("tournament", "entry_id", F.col("school").alias("school_name"), F.array(person("n1", "Ann"), person("n2", "Bo")).alias("people"))
    wrong = F.when(c % 6 == 0, F.concat(F.substr("n1", F.lit(1), F.lit(3)), F.lit("z"), F.substr("n1", F.lit(4)))).otherwise(F.col("n1"))
    first = F.when(c % 4 == 0, F.concat(F.lit("A. "), wrong)).when(c % 9 == 5, F.concat(F.lit("Z. "), wrong)).otherwise(wrong)
    rows = base.withColumn("c_custkey", F.col("c")).select("tournament", "row_idx", "school", first.alias("partner1"), F.when(c % 5 == 0, "").otherwise(F.col("n2")).alias("partner2"))
    return rows, cand


@query("score_candidates")
def score_candidates(t):
    return M.score_candidates(*sheet_teams(t))


@query("match_teams")
def match_teams(t):
    return M.match_teams(*sheet_teams(t)).select("tournament", "row_idx", "entry_id", "tier", "score", "ambiguous")


@query("pair_standings")
def pair_standings(t):
    rows, cand = sheet_teams(t)
    official = rows.select("row_idx", F.col("row_idx").alias("rank"), F.lit(10.0).alias("points"), F.concat_ws("/", "school", F.concat(F.lit("T"), "tournament")).alias("school"), "partner1", "partner2")
    ours = cand.select(F.col("entry_id").alias("team_id"), F.concat(F.lit("T"), "tournament").alias("school"), *[F.col("people")[i][p].alias(f"{p}{i + 1}") for i in (0, 1) for p in ("first", "last")], F.lit(9.0).alias("points"))
    return M.pair_standings(official, ours).select("row_idx", "team_id", "tier", "ambiguous", "delta")


@query("resolve_schools", """
SELECT supp, CASE k WHEN 0 THEN 'sch_nation' || n WHEN 1 THEN 'sch_nation' || n WHEN 2 THEN 'sch_nation1' ELSE 'sch_new' || CAST(supp AS VARCHAR) END AS school_id, CASE k WHEN 2 THEN 'NATION_1' WHEN 3 THEN 'New ' || CAST(supp AS VARCHAR) ELSE 'NATION_' || n END AS school_title,
  CASE k WHEN 3 THEN FALSE WHEN 2 THEN FALSE ELSE CAST(n AS INTEGER) % 2 = 0 END AS school_member FROM (SELECT s_suppkey AS supp, s_suppkey % 4 AS k, CAST(s_nationkey AS VARCHAR) AS n FROM supplier) AS s""")
def resolve_schools(t):
    n = t.raw("nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), F.concat(F.lit("Nat "), _s("n_nationkey")).alias("short_name"), F.lit("r").alias("region"))
    index = M.school_index(n, n.where("pos % 2 = 0").select("name"), n.where("pos = 1").select(F.lit("The Debate Club").alias("alias"), "name"))
    k = F.col("s_suppkey") % 4
    name = (F.when(k == 0, F.concat(F.lit("NATION_"), _s("s_nationkey"), F.lit(" High School"))).when(k == 1, F.concat(F.lit("nat "), _s("s_nationkey"), F.lit(" / x")))
            .when(k == 2, "Debate Club").otherwise(F.concat(F.lit("New "), _s("s_suppkey"))))
    return M.resolve_school(t.raw("supplier").select(F.col("s_suppkey").alias("supp"), name.alias("raw")), "raw", index).select("supp", "school_id", "school_title", "school_member")


# People are customers: few surnames per school, first names missing or short, histories by order.
CTES["folk"] = """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'lbl_' ELSE 'p' END || CAST(c_custkey AS VARCHAR) AS debater_id, 'n' || CAST(c_nationkey AS VARCHAR) AS school_id,
    'q' || chr(97 + CAST(c_custkey % 11 AS INTEGER)) AS last, CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 6 = 1 THEN 'jo' WHEN c_custkey % 6 = 2 THEN 'john' WHEN c_custkey % 6 = 3 THEN 'mary' ELSE 'x' || chr(97 + CAST((c_custkey // 7) % 9 AS INTEGER)) END AS first FROM customer"""
CTES["seen"] = """SELECT DISTINCT f.debater_id, strftime(o_orderdate, '%Y-%m') AS tournament_id, 'q' || chr(97 + CAST(o_orderkey % 3 AS INTEGER)) AS signature FROM orders JOIN folk AS f ON f.id = o_custkey WHERE o_orderkey % 3 = 0"""
CTES["blocks"] = """SELECT debater_id, first, unnest(CASE WHEN first <> '' THEN ['name|' || first || last, 'school|' || school_id || '|' || last, 'school|' || school_id || '|' || first || last] ELSE ['school|' || school_id || '|' || last] END) AS key FROM folk"""
CTES["clash"] = """SELECT DISTINCT a.debater_id AS a, b.debater_id AS b FROM (SELECT debater_id, tournament_id, count(*) AS n, min(signature) AS s FROM seen2 GROUP BY ALL) AS a
    JOIN (SELECT debater_id, tournament_id, count(*) AS n, min(signature) AS s FROM seen2 GROUP BY ALL) AS b ON a.tournament_id = b.tournament_id AND a.debater_id <> b.debater_id AND (a.n > 1 OR b.n > 1 OR a.s <> b.s)"""
CTES["seen2"] = """SELECT DISTINCT f.debater_id, strftime(o_orderdate, '%Y-%m') AS tournament_id, 'q' || chr(97 + CAST(o_orderkey % 3 AS INTEGER)) AS signature FROM orders JOIN folk AS f ON f.id = o_custkey"""
CTES["matched_pairs"] = """SELECT a.key, a.debater_id AS a, b.debater_id AS b, a.first AS fa, b.first AS fb, (a.first <> '' AND b.first <> '' AND NOT starts_with(a.first, b.first) AND NOT starts_with(b.first, a.first)) OR c.a IS NOT NULL AS bad
    FROM blocks AS a JOIN blocks AS b ON a.key = b.key AND a.debater_id < b.debater_id LEFT JOIN clash AS c ON c.a = a.debater_id AND c.b = b.debater_id"""
CTES["links"] = """SELECT DISTINCT a, b FROM matched_pairs WHERE NOT bad AND NOT ((fa = '' OR fb = '') AND key IN (SELECT key FROM matched_pairs WHERE bad AND fa <> '' AND fb <> ''))"""


def folk(t: DriverTables) -> DataFrame:
    c = F.col("c_custkey")
    first = (F.when(c % 6 == 0, "").when(c % 6 == 1, "jo").when(c % 6 == 2, "john").when(c % 6 == 3, "mary")
             .otherwise(F.concat(F.lit("x"), F.char(97 + (F.floor(c / 7) % 9).cast("int")))))
    return t.raw("customer").select(c.alias("id"), F.concat(F.when(c % 5 == 0, "lbl_").otherwise("p"), _s(c)).alias("debater_id"),
                                    F.concat(F.lit("n"), _s("c_nationkey")).alias("school_id"), F.concat(F.lit("q"), F.char(97 + (c % 11).cast("int"))).alias("last"), first.alias("first"))


def folk_seen(t: DriverTables) -> DataFrame:
    return t.raw("orders").join(folk(t).select("id", "debater_id"), F.col("o_custkey") == F.col("id")).select(
        "debater_id", F.date_format("o_orderdate", "yyyy-MM").alias("tournament_id"), F.concat(F.lit("q"), F.char(97 + (F.col("o_orderkey") % 3).cast("int"))).alias("signature")).distinct()


def folk_components(t: DriverTables) -> DataFrame:
    return loaded_as(t, "folk_components", lambda: GR.connected_components(I.same_person_links(folk(t), folk_seen(t))))


@query("identity_components", """
SELECT node, min(reach) AS component FROM (WITH RECURSIVE both_ways AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links), walk AS (SELECT x AS node, x AS reach FROM both_ways UNION SELECT w.node, e.y FROM walk AS w JOIN both_ways AS e ON e.x = w.reach) SELECT * FROM walk) AS z GROUP BY node""")
def identity_components(t):
    return folk_components(t)


@query("canonical_people")
def canonical_people(t):
    members = t.schools.where("is_member").select("school_id")
    return I.canonical_map(folk(t), I.elect_canonical(folk_components(t), folk(t), folk_seen(t), members))


@query("appearances", """
SELECT DISTINCT v.debater_id, e.tournament_id, CASE WHEN NOT e.two THEN '' ELSE lower(replace(p.last, 'Q', 'q')) END AS signature FROM entries AS e JOIN who AS v ON v.supp = e.supp
LEFT JOIN people AS p ON p.debater_id = CASE WHEN v.debater_id = e.d1 THEN e.d2 ELSE e.d1 END""")
def appearances(t):
    return I.appearances(t.links, t.entries.select("entry_id", "tournament_id"), t.people)


@query("blocking_keys", "SELECT key, count(*) AS records FROM blocks GROUP BY ALL")
def blocking_keys(t):
    return I.blocking_keys(folk(t)).groupBy("key").agg(F.count("*").alias("records"))


@query("ambiguous_blocks", "SELECT DISTINCT key FROM matched_pairs WHERE bad AND fa <> '' AND fb <> ''")
def ambiguous_blocks(t):
    return I.ambiguity_guard(I.blocking_keys(folk(t)), I._classes(folk_seen(t)))


@query("dominant_schools", """
SELECT pair, school_id FROM (SELECT e.pair, e.school_id, row_number() OVER (PARTITION BY e.pair ORDER BY 2 * count(*) + max(CASE WHEN s.is_member THEN 1 ELSE 0 END) DESC, min(e.entry_id)) AS rn FROM entries AS e JOIN schools AS s ON s.school_id = e.school_id WHERE e.pair IS NOT NULL GROUP BY e.pair, e.school_id) AS x WHERE rn = 1""")
def dominant_schools(t):
    e = t.entries.join(t.pairs.where("pair is not null").select("entry_id", "pair"), "entry_id")
    return I.dominant_school(e, ["pair"], t.members, "entry_id")


@query("collapsed_pairs", """
WITH x AS (SELECT a.debater_id || '|' || b.debater_id AS pair, a.school_id, least(a.last, b.last) || '|' || greatest(a.last, b.last) AS sur, least(a.first, b.first) || '|' || greatest(a.first, b.first) AS fs, a.first <> '' AND b.first <> '' AS full_named, a.first = '' AND b.first = '' AS anon
    FROM folk AS a JOIN folk AS b ON b.id = a.id + 1),
  f AS (SELECT *, first_value(pair) OVER w AS p0, first_value(anon) OVER w AS a0, first_value(fs) OVER w AS f0 FROM x WINDOW w AS (PARTITION BY school_id, sur ORDER BY pair)),
  n AS (SELECT school_id, sur, min(pair) AS p1, arg_min(fs, pair) AS f1 FROM x WHERE full_named GROUP BY ALL),
  g AS (SELECT f.*, n.p1, CASE WHEN (a0 AND (n.p1 IS NULL OR pair <= n.p1)) OR anon OR fs = CASE WHEN a0 THEN n.f1 ELSE f0 END THEN '' ELSE fs END AS sub FROM f LEFT JOIN n ON n.school_id = f.school_id AND n.sur = f.sur)
SELECT pair, CASE WHEN sub = '' THEN CASE WHEN a0 AND p1 IS NOT NULL THEN p1 ELSE p0 END ELSE min(pair) OVER (PARTITION BY school_id, sur, sub) END AS representative FROM g""")
def collapsed_pairs(t):
    p = folk(t)
    nxt = p.select((F.col("id") - 1).alias("id"), F.col("debater_id").alias("other"))
    pairs = p.join(nxt, "id").select(F.concat_ws("|", "debater_id", "other").alias("pair"), "school_id")
    return I.collapse_partnerships(pairs, p).select("pair", "representative")


@query("partnership_names", """
SELECT e.pair AS subject, a.x AS n1, b.x AS n2 FROM (SELECT DISTINCT pair FROM entries WHERE pair IS NOT NULL) AS e JOIN (SELECT debater_id, coalesce(first || ' ', '') || last AS x FROM people) AS a ON a.debater_id = split_part(e.pair, '|', 1)
JOIN (SELECT debater_id, coalesce(first || ' ', '') || last AS x FROM people) AS b ON b.debater_id = split_part(e.pair, '|', 2)""")
def partnership_names(t):
    s = t.pairs.where("pair is not null").select(F.col("pair").alias("subject")).distinct()
    return I.partnership_names(s, t.people, t.schools).select("subject", F.col("names")[0].alias("n1"), F.col("names")[1].alias("n2"))


def full_season(t: DriverTables, sources: C.InputSources) -> C.SeasonCases:
    """The scoring fact over the derived tournaments, with published rows made from their entries."""
    perf, stats = performance(t), field_table(t)
    none = lambda c, ty: F.lit(None).cast(ty).alias(c)
    tours = t.tournaments.select("name", "tournament_id", "category", F.lit(False).alias("ahead"), none("open_field", "int"), none("afs", "int"),
                                 none("open_elim_field", "int"), none("break_pct", "double"), none("prelim_count", "int"), none("breaking_wins", "int"), none("breaking_losses", "int"))
    titled = t.schools.select("school_id", F.concat(F.lit("Nation "), F.regexp_replace("school_id", "n", "")).alias("school_name"))
    entries = t.entries.join(titled, "school_id").withColumn("code", F.lit(None).cast("string")).withColumn("name", F.lit(None).cast("string"))
    s = F.col("supp")
    people = t.people.select(F.col("debater_id").alias("student_id"), F.coalesce("first", F.lit("")).alias("first"), F.concat("last", "last", "last").alias("last"))
    students = entries.select("tournament_id", F.explode("student_ids").alias("student_id")).distinct().join(people, "student_id")
    last = lambda i: people.select(F.col("student_id").alias(f"d{i}"), F.col("last").alias(f"partner{i}"))
    rows = (entries.where((F.col("division") == "open") & (s % 4 != 3)).select("tournament_id", "supp", "school_name", F.col("student_ids")[0].alias("d1"), F.get("student_ids", F.lit(1)).alias("d2"))
            .join(last(1), "d1").join(last(2), "d2", "left").join(t.tournaments.select("tournament_id", F.col("name").alias("tournament")), "tournament_id")
            .select("tournament", s.cast("int").alias("row_idx"), F.col("school_name").alias("school1"), F.lit("").alias("school2"), "partner1", F.coalesce("partner2", F.lit("")).alias("partner2"),
                    F.when(s % 8 == 1, "qual").otherwise("3-2").alias("result"), none("walkover_adjustment", "int"), (s % 10).cast("int").alias("calc_points"), none("base_points", "int"),
                    none("break_prelim_adjustment", "int"), F.lit(False).alias("hybrid")))
    index = M.school_index(titled.select(F.regexp_replace("school_id", "n", "").cast("int").alias("pos"), F.col("school_name").alias("name"), F.lit("").alias("short_name"), F.lit("r").alias("region")))
    events = t.events.select("tournament_id", "event_id", F.lit("Parli").alias("name"), "division", "is_parli")
    empty = t.spark.createDataFrame([], "tournament string, pair string, points double, source string")
    return C.season_cases(tours, rows, t.tournaments.select("tournament_id", "name"), events, stats, perf, entries, students, index, empty, empty.select("tournament"), sources)


@query("season_cases")
def season_cases(t):
    return full_season(t, C.ALL_SHEET).cases


@query("season_cases_ours")
def season_cases_ours(t):
    return full_season(t, C.ALL_OURS).cases
