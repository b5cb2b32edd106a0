import itertools
import random

import pytest
from pyspark.sql import functions as F

from verdikt.functions.text import letters
from verdikt.operators import graph as GR, identity as I, matching as M

TEAM = "tournament string, row_idx int, school string, partner1 string, partner2 string"
CAND = "tournament string, entry_id string, school_name string, people array<struct<first:string,last:string>>"
A = ("T", "A", "Hill", [("Cara", "Vale"), ("Rory", "Hu")])
B = ("T", "B", "Hill", [("Milo", "Vale"), ("Lena", "Hu")])


def match(spark, teams, cands):
    rows = [("T", i, school, a, b) for i, (school, a, b) in enumerate(teams)]
    out = M.match_teams(spark.createDataFrame(rows, TEAM), spark.createDataFrame(cands, CAND))
    return {r.row_idx: (r.entry_id, r.tier, r.ambiguous) for r in out.collect()}


def test_initials_settle_and_ambiguity_is_flagged(spark):
    got = match(spark, [("Hill", "C. Vale", "R. Hu"), ("Hill", "M. Vale", "L. Hu")], [A, B])
    assert got == {0: ("A", "exact-initials", False), 1: ("B", "exact-initials", False)}
    assert match(spark, [("Hill", "Vale", "Hu")], [A, B])[0] == ("A", "exact-surnames", True)
    two = match(spark, [("Hill", "Vale", "Hu"), ("Hill", "Vale", "Hu")], [A, B])
    assert {two[0][0], two[1][0]} == {"A", "B"}
    assert match(spark, [("Hill", "Q. Vale", "Q. Hu")], [A, B])[0][0] is None


def test_misspelling_needs_the_school(spark):
    c = ("T", "S", "Hill High", [("Ann", "Stonebridge"), ("Bo", "Quill")])
    assert match(spark, [("Hill", "Quill", "Stonebrige")], [c])[0][:2] == ("S", "fuzzy-surname")
    assert match(spark, [("Other", "Stonebrige", "Quill")], [c])[0][0] is None
    solo = ("T", "N", "Hill", [("Ann", "Ng")])
    assert match(spark, [("Hill", "Ng", "")], [solo])[0][:2] == ("N", "partial-maverick")


def test_matching_equals_best_first(spark):
    rng = random.Random(3)
    scored = [("T", i, f"e{j:02d}", rng.randint(1, 6)) for i in range(14) for j in range(14) if rng.random() < 0.4]
    df = spark.createDataFrame(scored, "tournament string, row_idx int, entry_id string, score int")
    got = {r.row_idx: (r.entry_id, r.ambiguous) for r in M.match_one_to_one(df, ["tournament"]).collect()}
    want, used = {}, set()
    for _, i, e, s in sorted(scored, key=lambda x: (-x[3], x[1], x[2])):
        if i in want or e in used:
            continue
        rival = any(o[1] == i and o[3] == s and o[2] != e and o[2] not in used for o in scored)
        want[i] = (e, rival)
        used.add(e)
    assert got == want


def test_components(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(30) if i % 7] + [("n3", "m1"), ("m1", "m2")]
    got = {r.node: r.component for r in GR.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    assert got == {x: min(g) for g in groups.values() for x in g}


def test_same_person_links_against_all_pairs(spark):
    rng = random.Random(11)
    firsts = ["", "", "j", "jo", "john", "mary"]
    people = [(f"{'lbl_' if rng.random() < .3 else 'p'}{i:03d}", rng.choice(firsts), rng.choice(["lee", "ng"]), rng.choice(["s1", "s2"])) for i in range(60)]
    seen = sorted({(p[0], f"t{rng.randint(0, 9)}", rng.choice(["x", "y"])) for p in people for _ in range(rng.randint(0, 4))})
    pd = spark.createDataFrame(people, "debater_id string, first string, last string, school_id string")
    sd = spark.createDataFrame(seen, "debater_id string, tournament_id string, signature string")
    got = {r.node: r.component for r in GR.connected_components(I.same_person_links(pd, sd)).collect()}
    at = {}
    for d, t, s in seen:
        at.setdefault(d, {}).setdefault(t, set()).add(s)

    def conflict(a, b):
        if a[1] and b[1] and not a[1].startswith(b[1]) and not b[1].startswith(a[1]):
            return True
        return any(len(at[a[0]][t] | at[b[0]][t]) > 1 for t in set(at.get(a[0], {})) & set(at.get(b[0], {})))
    blocks = {}
    for p in people:
        keys = {f"school|{p[3]}|{p[2]}", f"school|{p[3]}|{p[1]}{p[2]}"} | ({f"name|{p[1]}{p[2]}"} if p[1] else set())
        for k in keys:
            blocks.setdefault(k, []).append(p)
    parent = {p[0]: p[0] for p in people}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for g in blocks.values():
        amb = any(a[1] and b[1] and conflict(a, b) for a, b in itertools.combinations(g, 2))
        for a, b in itertools.combinations(g, 2):
            if not (amb and not (a[1] and b[1])) and not conflict(a, b):
                parent[find(a[0])] = find(b[0])
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    assert got == {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


def test_collapse_equals_the_ordered_fold(spark):
    rng = random.Random(2)
    people = [(f"d{i:02d}", rng.choice(["", "", "ann", "bo"]), rng.choice(["lee", "ng"])) for i in range(24)]
    pd = spark.createDataFrame(people, "debater_id string, first string, last string")
    pairs = sorted({"|".join(sorted(rng.sample([p[0] for p in people], 2))) for _ in range(70)})
    rows = [(p, rng.choice(["s", "t"])) for p in pairs]
    got = {r.pair: r.representative for r in I.collapse_partnerships(spark.createDataFrame(rows, "pair string, school_id string"), pd).collect()}
    first = {p[0]: p[1] for p in people}
    last = {p[0]: p[2] for p in people}
    made = {}
    for pair, school in rows:
        ids = pair.split("|")
        firsts = "|".join(sorted(first[i] for i in ids))
        key = f"{school}::" + "|".join(sorted(last[i] for i in ids))
        if key in made:
            other = "|".join(sorted(first[i] for i in made[key]["ids"]))
            if firsts.strip("|") and other.strip("|") and firsts != other:
                key += f"::{firsts}"
        if key in made:
            made[key]["pairs"].append(pair)
            if any(not first[i] for i in made[key]["ids"]) and all(first[i] for i in ids):
                made[key]["ids"] = ids
        else:
            made[key] = {"pairs": [pair], "ids": ids}
    assert got == {p: "|".join(m["ids"]) for m in made.values() for p in m["pairs"]}


def test_dominant_school_prefers_members_on_ties(spark):
    df = spark.createDataFrame([("p", "x", 1), ("p", "y", 2), ("q", "x", 1), ("q", "x", 2), ("q", "y", 3)], "pair string, school_id string, pos int")
    members = spark.createDataFrame([("y",)], "school_id string")
    got = {r.pair: r.school_id for r in I.dominant_school(df, ["pair"], members, "pos").collect()}
    assert got == {"p": "y", "q": "x"}


def test_accents_fold(spark):
    df = spark.createDataFrame([("Élan Ñuñez",)], "s string").select(letters("s"))
    assert df.first()[0] == "elannunez"


def test_standings_pair_hybrids_and_claim_once(spark):
    official = spark.createDataFrame([(0, 1, 10.0, "Hill/Dale", "Vale", "Hu"), (1, 2, 9.0, "Dale", "Vale", "Hu")],
                                     "row_idx int, rank int, points double, school string, partner1 string, partner2 string")
    ours = spark.createDataFrame([("t1", "Dale", "C", "Vale", "R", "Hu", 10.0)],
                                 "team_id string, school string, first1 string, last1 string, first2 string, last2 string, points double")
    got = {r.row_idx: (r.team_id, r.delta) for r in M.pair_standings(official, ours).collect()}
    assert got == {0: ("t1", 0.0), 1: (None, None)}


def test_matching_by_class_equals_matching_of_pairs(spark, monkeypatch):
    rng = random.Random(8)
    last = ["Vale", "Hunt", "Hunts", "Vlae", "Ng"]
    sheet = lambda: rng.choice(["", "", "", "C. ", "R. "]) + rng.choice(last)
    school = lambda: rng.choice(["Hill", "Hill Dale", "Dale", "Moor"])
    rows = [(rng.choice("TU"), i, school(), sheet(), rng.choice(["", sheet()])) for i in range(60)]
    cands = [(rng.choice("TU"), f"e{j:02d}", school(), [(rng.choice(["Cara", "Rory", ""]), rng.choice(last)) for _ in range(rng.choice([1, 2, 2, 3]))]) for j in range(60)]
    teams, cands = spark.createDataFrame(rows, TEAM), spark.createDataFrame(cands, CAND)
    columns = ["tournament", "row_idx", "entry_id", "tier", "score", "ambiguous"]
    want = M.match_one_to_one(M.score_candidates(teams, cands), ["tournament"]).select(*columns)
    monkeypatch.setattr(M, "score_candidates", None)
    got = M.match_teams(teams, cands).where("entry_id is not null").select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_many_alike_match_in_few_steps(spark, monkeypatch):
    """A class of rows and entries of one name: one step a level, not one a pair."""
    n = 300
    rows = [("T", i, "Hill", "Vale", "Hunt" if i % 3 else "") for i in range(n)]
    cands = [("T", f"e{j:03d}", "Hill", [("Cara", "Vale"), ("Rory", "Hunt")]) for j in range(n)]
    monkeypatch.setattr(M, "SMALL", 0)
    steps, cut = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df, *by: steps.append(1) or cut(df, *by))
    got = {r.row_idx: (r.entry_id, r.ambiguous) for r in M.match_teams(spark.createDataFrame(rows, TEAM), spark.createDataFrame(cands, CAND)).collect()}
    order = [i for i in range(n) if i % 3] + [i for i in range(n) if not i % 3]
    assert got == {i: (f"e{j:03d}", j < n - 1) for j, i in enumerate(order)}
    assert len(steps) < 60


def test_tangled_classes_match_in_stretches(spark, monkeypatch):
    """Classes that some but not all others meet, in groups too large for one task: few steps, and the pairs of best-first."""
    rng = random.Random(5)
    last = ["Vale", "Hunt", "Vales", "Ng"]
    rows = [("T", i, "Hill", rng.choice(last), rng.choice(["", rng.choice(last)])) for i in range(160)]
    cands = [("T", f"e{j:03d}", "Hill", [("Cara", rng.choice(last)), ("Rory", rng.choice(last))]) for j in range(140)]
    teams, cands = spark.createDataFrame(rows, TEAM), spark.createDataFrame(cands, CAND)
    columns = ["tournament", "row_idx", "entry_id", "tier", "score", "ambiguous"]
    want = M.match_one_to_one(M.score_candidates(teams, cands), ["tournament"]).select(*columns).collect()
    monkeypatch.setattr(M, "SMALL", 0)
    monkeypatch.setattr(M, "IN_TURN", 250, raising=False)
    steps, cut = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df, *by: steps.append(1) or cut(df, *by))
    got = M.match_teams(teams, cands).where("entry_id is not null").select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert len(steps) < 100


@pytest.mark.parametrize("small", [100_000, 0])
def test_standings_by_class_equal_standings_by_pairs(spark, monkeypatch, small):
    rng = random.Random(9)
    n, last, halves = (50, ["Vale", "Hunt", "Hunts", "Ng"], ["Hill", "Dale", "Moor", "Glen"]) if small else (30, ["Vale", "Hunt"], ["Hill", "Dale"])
    school = lambda: "/".join(rng.sample(halves, rng.choice([1, 1, 2]))) if rng.random() < 0.9 else "Lone"
    initial = lambda: rng.choice(["", "", "C. "]) if small else ""
    official = [(i, i + 1, 10.0, school(), initial() + rng.choice(last), rng.choice(["", rng.choice(last)])) for i in range(n)]
    ours = [(f"t{j:02d}", school(), rng.choice(["Cara", ""]), rng.choice(last), "Rory", rng.choice(last), 9.0) for j in range(n)]
    official = spark.createDataFrame(official, "row_idx int, rank int, points double, school string, partner1 string, partner2 string")
    ours = spark.createDataFrame(ours, "team_id string, school string, first1 string, last1 string, first2 string, last2 string, points double")
    listed = {}

    def by_pairs(teams, candidates):
        pairs = M.score_candidates(teams, candidates, "pool").join(teams.groupBy("pool").agg(F.min("turn").alias("turn_")), "pool")
        listed["want"] = M.match_one_to_one(pairs, ["pool"], entry_scope=[], lead=["turn_"]).cache()
        return listed["want"]

    columns = ["row_idx", "team_id", "tier", "ambiguous", "delta"]
    with monkeypatch.context() as m:
        m.setattr(M, "match_pools", by_pairs, raising=False)
        want = M.pair_standings(official, ours).select(*columns).collect()
    monkeypatch.setattr(M, "score_candidates", None)
    monkeypatch.setattr(M, "SMALL", small)
    got = M.pair_standings(official, ours).select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(r.team_id is not None for r in got) > n // 3
