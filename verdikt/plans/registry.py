"""Named queries over the driver tables, each with the SQL that must return the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdikt.plans.driver_tables import DriverTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}  # as written; ``with_ctes`` completes them

# Shared table expressions, named as the adapter names its tables.
CTES: dict[str, str] = {
    "o": """SELECT o_orderkey AS k, o_custkey AS c, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS starts_on,
              o_orderpriority = '1-URGENT' AS urgent FROM orders""",
    "s0": "SELECT l_orderkey AS k, min(l_suppkey) AS s1, max(l_suppkey) AS s2 FROM lineitem GROUP BY l_orderkey",
    "e0": """SELECT o.*, s0.s1, s0.s2, strftime(starts_on, '%Y-%m-%d') AS tournament_id,
               CASE WHEN c % 10 = 0 THEN 'novice' ELSE 'open' END AS division,
               1995 + 2 * ((CAST(year(starts_on) AS INTEGER) - 1995) // 2) AS y0 FROM o JOIN s0 ON o.k = s0.k""",
    "u": """SELECT k, (n - 1) // 15 AS bracket, 1 + (n - 1) % 15 AS rn FROM (
              SELECT k, row_number() OVER (PARTITION BY tournament_id, division ORDER BY k) AS n FROM e0 WHERE urgent) AS x""",
    "field_blocks": """SELECT tournament_id, division, (count(*) - 1) // 15 + 1 AS blocks FROM e0 WHERE urgent GROUP BY ALL""",
    "rooms": """SELECT a.*, event_id || ':' || name AS round_id FROM (
              SELECT e0.k, e0.starts_on, e0.tournament_id, e0.division, e0.s1, e0.s2,
                CAST(y0 AS VARCHAR) || '-' || lpad(CAST((y0 + 2) % 100 AS VARCHAR), 2, '0') AS season_id,
                e0.tournament_id || ':' || e0.division || ':' || CAST(coalesce(bracket, e0.k % coalesce(blocks, 1)) AS VARCHAR) AS event_id,
                CASE WHEN urgent THEN 'elim' ELSE 'prelim' END AS kind,
                CASE WHEN NOT urgent THEN CAST(1 + e0.k % 5 AS VARCHAR) WHEN rn <= 8 THEN '6' WHEN rn <= 12 THEN '7'
                     WHEN rn <= 14 THEN '8' ELSE '9' END AS name,
                CAST(e0.k AS VARCHAR) AS section_id
              FROM e0 LEFT JOIN u ON e0.k = u.k
                LEFT JOIN field_blocks AS x ON x.tournament_id = e0.tournament_id AND x.division = e0.division) AS a""",
    "ballots": """SELECT r.season_id, r.tournament_id, r.starts_on, r.event_id, r.division, r.round_id, r.name, r.kind,
                r.section_id, z.side, CASE WHEN z.side = 1 THEN r.s1 ELSE r.s2 END AS supp,
                r.event_id || ':' || CAST(CASE WHEN z.side = 1 THEN r.s1 ELSE r.s2 END AS VARCHAR) AS entry_id,
                CASE l.l_returnflag WHEN 'A' THEN z.side = 1 WHEN 'R' THEN z.side = 2 END AS won,
                r.s1 = r.s2 AS is_bye
              FROM rooms AS r JOIN lineitem AS l ON l.l_orderkey = r.k
              JOIN (VALUES (1), (2)) AS z(side) ON z.side = 1 OR r.s1 <> r.s2""",
    "suppliers": """SELECT s_suppkey AS supp, 'n' || CAST(s_nationkey AS VARCHAR) AS school_id,
                CASE WHEN s_suppkey % 10 = 3 THEN 'n' || CAST((s_nationkey + 1) % 25 AS VARCHAR) END AS hybrid_school_id,
                'd' || CAST(s_suppkey % 60 AS VARCHAR) AS d1, 'd' || CAST(60 + s_suppkey % 37 AS VARCHAR) AS d2,
                s_suppkey % 25 <> 4 AS two, s_suppkey % 50 = 7 AS dropped FROM supplier""",
    "entries": """SELECT DISTINCT r.season_id, r.tournament_id, r.event_id, r.division, x.supp,
                r.event_id || ':' || CAST(x.supp AS VARCHAR) AS entry_id, x.school_id, x.hybrid_school_id, x.d1, x.d2, x.two,
                x.dropped, CASE WHEN x.two THEN least(x.d1, x.d2) || '|' || greatest(x.d1, x.d2) END AS pair
              FROM rooms AS r JOIN suppliers AS x ON x.supp = r.s1 OR x.supp = r.s2""",
    "who": "SELECT supp, d1 AS debater_id FROM suppliers UNION ALL SELECT supp, d2 FROM suppliers WHERE two",
    "people": """SELECT debater_id, CASE WHEN i % 4 <> 0 THEN 'F' || CAST(i AS VARCHAR) END AS first,
                'Q' || chr(97 + i % 26) || chr(97 + (i // 26) % 26) AS last, 'n' || CAST(i % 25 AS VARCHAR) AS school_id,
                i % 13 = 5 AS suppressed,
                CASE WHEN i % 13 = 5 THEN NULL WHEN i % 4 <> 0 THEN 'F' || CAST(i AS VARCHAR) || ' ' ELSE '' END
                  || 'Q' || chr(97 + i % 26) || chr(97 + (i // 26) % 26) AS shown
              FROM (SELECT DISTINCT debater_id, CAST(replace(debater_id, 'd', '') AS INTEGER) AS i FROM who) AS w""",
    "schools": """SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS school_id, n_name AS name,
                CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS short_name, r_name AS region, n_nationkey % 2 = 0 AS is_member
              FROM nation LEFT JOIN region ON r_regionkey = n_regionkey""",
    "per_round": """SELECT event_id, entry_id, round_id, count(*) FILTER (WHERE coalesce(won, is_bye)) AS w,
                count(*) AS n, count(won) AS scored FROM ballots
              WHERE kind = 'prelim' AND (won IS NOT NULL OR is_bye) GROUP BY ALL""",
    "record": """SELECT event_id, entry_id, CAST(count(*) FILTER (WHERE w * 2 > n) AS INTEGER) AS wins,
                CAST(count(*) FILTER (WHERE w * 2 <= n) AS INTEGER) AS losses, CAST(count(*) AS INTEGER) AS debated,
                CAST(sum(scored) AS INTEGER) AS scored_ballots FROM per_round GROUP BY ALL""",
    "elim_rooms": """SELECT * FROM rooms WHERE kind = 'elim'""",
    "in_round": """SELECT DISTINCT event_id, name, x.supp FROM elim_rooms, LATERAL (SELECT unnest([s1, s2]) AS supp) AS x""",
    "shared": """SELECT DISTINCT a.event_id, a.name AS n1, b.name AS n2 FROM in_round AS a JOIN in_round AS b
              ON a.event_id = b.event_id AND a.supp = b.supp""",
    "top_round": "SELECT event_id, max(name) AS top FROM elim_rooms GROUP BY event_id",
    "kept9": "SELECT event_id, top AS name FROM top_round",
    "kept8": """SELECT * FROM kept9 UNION SELECT s.event_id, s.n1 FROM shared AS s JOIN kept9 AS k
              ON k.event_id = s.event_id AND k.name = s.n2 WHERE s.n1 = '8' AND s.n1 < s.n2""",
    "kept7": """SELECT * FROM kept8 UNION SELECT s.event_id, s.n1 FROM shared AS s JOIN kept8 AS k
              ON k.event_id = s.event_id AND k.name = s.n2 WHERE s.n1 = '7' AND s.n1 < s.n2""",
    "main_rounds": """SELECT * FROM kept7 UNION SELECT s.event_id, s.n1 FROM shared AS s JOIN kept7 AS k
              ON k.event_id = s.event_id AND k.name = s.n2 WHERE s.n1 = '6' AND s.n1 < s.n2""",
    "main_ballots": """SELECT b.* FROM ballots AS b JOIN main_rounds AS m ON m.event_id = b.event_id AND m.name = b.name
              WHERE b.kind = 'elim'""",
    "main_sides": """SELECT s.*, s.won_n * 2 > s.decided AS maj, c.sections, c.round_panel,
                x.pair, x.section_decided FROM (
              SELECT event_id, name, section_id, entry_id, supp, count(*) AS panel, count(won) AS decided,
                count(*) FILTER (WHERE won) AS won_n FROM main_ballots GROUP BY ALL) AS s
              JOIN (SELECT event_id, name, count(DISTINCT section_id) AS sections, max(p) AS round_panel FROM (
                SELECT event_id, name, section_id, entry_id, count(*) AS p FROM main_ballots GROUP BY ALL) AS q GROUP BY ALL) AS c
                ON c.event_id = s.event_id AND c.name = s.name
              JOIN (SELECT b.section_id, count(DISTINCT b.entry_id) = 2 AND count(DISTINCT z.school_id) = 1 AS pair,
                  count(b.won) AS section_decided FROM main_ballots AS b JOIN suppliers AS z ON z.supp = b.supp GROUP BY ALL) AS x
                ON x.section_id = s.section_id""",
    "prelim_table": """SELECT * FROM (VALUES ('2-1', 4), ('3-0', 8), ('3-1', 7), ('4-0', 11), ('3-2', 4), ('4-1', 10),
                ('5-0', 14), ('4-2', 6), ('5-1', 12), ('6-0', 16)) AS t(rec, pts)""",
    "results": """SELECT e.*, coalesce(t.pts, 0) AS points, r.wins, r.losses,
                CASE WHEN NOT e.two THEN 'teamSize' END AS excluded_reason
              FROM entries AS e JOIN record AS r ON r.entry_id = e.entry_id
              LEFT JOIN prelim_table AS t ON t.rec = CAST(r.wins AS VARCHAR) || '-' || CAST(r.losses AS VARCHAR)""",
    "counting": "SELECT * FROM results WHERE excluded_reason IS NULL AND points > 0",
    "weights": "SELECT * FROM (VALUES (1, 1.0), (2, 0.9), (3, 0.6), (4, 0.3), (5, 0.1)) AS t(place, weight)",
    "team_totals": """SELECT p.*, rank() OVER (PARTITION BY season_id ORDER BY points DESC) AS rank FROM (
              SELECT a.season_id, a.pair, round(CAST(sum(a.points * w.weight) AS DOUBLE), 6) AS points,
                CAST(count(w.weight) AS INTEGER) AS tournaments_counted
              FROM (SELECT *, row_number() OVER (PARTITION BY season_id, pair ORDER BY points DESC, entry_id) AS place
                    FROM counting) AS a JOIN weights AS w ON w.place = a.place GROUP BY ALL) AS p""",
    "home": """SELECT season_id, pair, school_id FROM (
              SELECT c.season_id, c.pair, c.school_id, row_number() OVER (PARTITION BY c.season_id, c.pair
                ORDER BY count(*) * 2 + max(CASE WHEN s.is_member THEN 1 ELSE 0 END) DESC, min(c.entry_id)) AS rn
              FROM counting AS c JOIN schools AS s ON s.school_id = c.school_id
              GROUP BY c.season_id, c.pair, c.school_id) AS h WHERE rn = 1""",
    "debater_totals": """SELECT p.*, rank() OVER (PARTITION BY season_id ORDER BY points DESC) AS rank,
                points >= 40 AS auto_qualified FROM (
              SELECT a.season_id, a.debater_id, round(CAST(sum(a.points * w.weight) AS DOUBLE), 6) AS points,
                CAST(count(w.weight) AS INTEGER) AS tournaments_counted
              FROM (SELECT c.*, v.debater_id, row_number() OVER (PARTITION BY season_id, v.debater_id
                      ORDER BY points DESC, entry_id) AS place
                    FROM counting AS c JOIN who AS v ON v.supp = c.supp) AS a
              JOIN weights AS w ON w.place = a.place GROUP BY ALL) AS p""",
    "school_totals": """SELECT p.*, rank() OVER (PARTITION BY season_id ORDER BY points DESC) AS rank FROM (
              SELECT x.season_id, x.school_id, sum(x.share) AS points FROM (
                SELECT season_id, school_id, points * CASE WHEN hybrid_school_id IS NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS share FROM counting
                UNION ALL SELECT season_id, hybrid_school_id, points * 0.5::DOUBLE FROM counting
                WHERE hybrid_school_id IS NOT NULL) AS x
              JOIN schools AS s ON s.school_id = x.school_id AND s.is_member GROUP BY ALL) AS p""",
    "tournaments": """SELECT DISTINCT season_id, tournament_id, starts_on, CAST(starts_on + INTERVAL 2 DAY AS DATE) AS ends_on,
                CASE WHEN quarter(starts_on) = 4 THEN 'NYPDL ' ELSE 'Open ' END || tournament_id AS name,
                CASE WHEN quarter(starts_on) = 2 THEN 'CHSSA' ELSE 'Regular' END AS category FROM rooms""",
    "sides": """SELECT season_id, tournament_id, starts_on, event_id, kind, section_id, entry_id, supp, min(side) AS side,
                bool_or(is_bye) AS is_bye, count(won) AS decided, count(*) FILTER (WHERE won) AS won
              FROM ballots WHERE division = 'open' GROUP BY ALL""",
    "classified": """SELECT x.season_id, x.tournament_id, starts_on, section_id, kind, a.pair AS a, b.pair AS b, won_a, ballots, side_a,
                CASE WHEN bye THEN 'bye' WHEN n <> 2 THEN 'odd_section' WHEN ballots = 0 THEN 'undecided'
                     WHEN won_a * 2 = ballots THEN 'tied' WHEN a.pair IS NULL OR b.pair IS NULL THEN 'unknown_team'
                     WHEN a.pair = b.pair THEN 'self_match' ELSE 'rated' END AS reason
              FROM (SELECT season_id, tournament_id, starts_on, section_id, kind, bool_or(is_bye) AS bye, count(*) AS n,
                      max(decided) AS ballots, min(entry_id) AS ea, max(entry_id) AS eb, arg_min(won, entry_id) AS won_a,
                      arg_min(side, entry_id) AS side_a FROM sides
                    GROUP BY season_id, tournament_id, starts_on, section_id, kind) AS x
              JOIN entries AS a ON a.entry_id = x.ea JOIN entries AS b ON b.entry_id = x.eb""",
    "periods": """SELECT *, row_number() OVER (PARTITION BY season_id ORDER BY starts_on, tournament_id, phase) AS period_seq,
                phase = max(phase) OVER (PARTITION BY season_id, tournament_id) AS final FROM (
              SELECT season_id, tournament_id, starts_on, CASE WHEN kind = 'elim' THEN 1 ELSE 0 END AS phase,
                CAST(count(*) FILTER (WHERE reason = 'rated') AS INTEGER) AS rounds FROM classified
              WHERE reason = 'rated' OR (reason IN ('undecided', 'tied', 'unknown_team') AND (a IS NOT NULL OR b IS NOT NULL))
              GROUP BY ALL) AS p""",
    "rated": """SELECT c.*, p.period_seq FROM classified AS c JOIN periods AS p ON p.season_id = c.season_id
                AND p.tournament_id = c.tournament_id AND p.phase = CASE WHEN c.kind = 'elim' THEN 1 ELSE 0 END
              WHERE reason = 'rated'""",
    "gains": """SELECT g.season_id, g.pair AS subject, p.period_seq AS at, max(g.points)::DOUBLE AS points FROM results AS g
              JOIN periods AS p ON p.season_id = g.season_id AND p.tournament_id = g.tournament_id AND p.final
              WHERE g.excluded_reason IS NULL AND g.division = 'open' GROUP BY ALL""",
    "gain_totals": """SELECT season_id, subject, period_seq, round(sum(points * weight)::DOUBLE, 6) AS total FROM (
              SELECT n.season_id, n.subject, n.period_seq, g.points, row_number() OVER (
                PARTITION BY n.season_id, n.subject, n.period_seq ORDER BY g.points DESC) AS rn
              FROM (SELECT season_id, a AS subject, period_seq FROM rated UNION SELECT season_id, b, period_seq FROM rated) AS n
              JOIN gains AS g ON g.season_id = n.season_id AND g.subject = n.subject AND g.at < n.period_seq) AS x
              JOIN weights AS w ON w.place = x.rn GROUP BY ALL""",
    "line_scores": """SELECT r.season_id, r.tournament_id, CASE WHEN quarter(r.starts_on) = 4 THEN 'NYPDL ' ELSE 'Open ' END
                  || r.tournament_id AS tournament, r.event_id, r.division, r.round_id, r.section_id,
                r.event_id || ':' || CAST(l.l_suppkey AS VARCHAR) AS entry_id,
                'd' || CAST(CASE WHEN l.l_linenumber % 2 = 0 THEN l.l_suppkey % 60 ELSE 60 + l.l_suppkey % 37 END AS VARCHAR) AS debater_id,
                CAST(l.l_partkey % 200 AS VARCHAR) AS judge_id,
                CASE WHEN l.l_quantity >= 50 THEN 0.0::DOUBLE ELSE 25 + l.l_quantity / 10 END AS raw,
                CASE WHEN quarter(r.starts_on) = 4 THEN 23.0::DOUBLE ELSE 25.0::DOUBLE END AS lo
              FROM rooms AS r JOIN lineitem AS l ON l.l_orderkey = r.k""",
    "usable": """SELECT *, 25 + (raw - lo) * 5.0::DOUBLE / (30 - lo) AS canonical FROM line_scores
              WHERE division = 'open' AND NOT (raw = 0) AND raw BETWEEN lo - (30 - lo) AND 30 + (30 - lo) * 0.1::DOUBLE""",
    "pool": """SELECT season_id, quantile_cont(canonical, 0.5) AS centre,
                (quantile_cont(canonical, 0.75) - quantile_cont(canonical, 0.25)) / 1.349::DOUBLE AS spread FROM usable GROUP BY ALL""",
    "judge": """SELECT season_id, judge_id, count(*) AS n, quantile_cont(canonical, 0.5) AS centre,
                (quantile_cont(canonical, 0.75) - quantile_cont(canonical, 0.25)) / 1.349::DOUBLE AS spread FROM usable GROUP BY ALL""",
    "normalized": """SELECT u.*, p.centre AS pool_centre, p.spread AS pool_spread,
                (u.canonical - (j.n / (j.n + 12.0::DOUBLE) * j.centre + (1 - j.n / (j.n + 12.0::DOUBLE)) * p.centre))
                / greatest(0.35::DOUBLE, j.n / (j.n + 12.0::DOUBLE) * j.spread + (1 - j.n / (j.n + 12.0::DOUBLE)) * p.spread) AS z
              FROM usable AS u JOIN pool AS p ON p.season_id = u.season_id
              JOIN judge AS j ON j.season_id = u.season_id AND j.judge_id = u.judge_id""",
    "speakers": """SELECT season_id, debater_id AS person_id, CAST(count(*) AS INTEGER) AS ballots, avg(z) AS mean_z,
                coalesce(stddev_samp(z), 0) AS sd_z, avg(canonical) AS mean_raw, max(pool_centre) AS pool_centre,
                max(pool_spread) AS pool_spread FROM normalized GROUP BY ALL""",
}


def with_ctes(body: str) -> str:
    """``body`` behind the table expressions it names, and those they name."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    own = body.strip()
    start = "WITH RECURSIVE " if own.startswith("WITH RECURSIVE") else "WITH "
    rest = ",\n" + own[len(start):] if own.startswith("WITH") else "\n" + own
    return start + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + rest


def query(name: str, sql: str | None = None):
    """Registers ``fn(tables) -> DataFrame`` and its SQL, if it has one."""

    def keep(fn: Callable[[DriverTables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(DriverTables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep
