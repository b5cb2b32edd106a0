from pyspark.sql import functions as F

from verdikt.operators import brackets as B

ENTRY = "event_id string, entry_id string, school_id string, dropped boolean"
ROUND = "event_id string, round_id string, round_pos int, name string, label string, type string, is_prelim boolean, is_elim boolean"
BALLOT = "event_id string, round_id string, section_id string, entry_id string, won boolean, is_bye boolean"
PUB = ("event_id string, entry_id string, prelim_wins double, prelim_ballots double, rec_wins int, rec_losses int, rec_rounds int, "
       "seed int, champion boolean")


def event(spark, rounds, seeds=None, schools=None, entries="abcd", champions=""):
    """rounds: (name, type, [room, ...]); in a room the first entry wins, unless a dict says who won."""
    rr, bb = [], []
    for pos, (name, kind, rooms, *label) in enumerate(rounds):
        rr.append(("e", f"r{pos}", pos, name, label[0] if label else "", kind, kind == "highhigh", kind in ("elim", "final")))
        for i, room in enumerate(rooms):
            votes = room if isinstance(room, dict) else ({room[0]: [None]} if len(room) == 1 else {room[0]: [True], room[1]: [False]})
            for who, cast in votes.items():
                bb += [("e", f"r{pos}", f"r{pos}s{i}", who, w, len(votes) == 1) for w in cast]
    ee = [("e", x, (schools or {}).get(x), False) for x in entries]
    pp = [("e", x, None, None, None, None, 0, (seeds or {}).get(x), x in champions) for x in entries]
    return (spark.createDataFrame(ee, ENTRY), spark.createDataFrame(rr, ROUND), spark.createDataFrame(bb, BALLOT),
            spark.createDataFrame(pp, PUB))


PRELIMS = [("1", "highhigh", ["ab", "cd"]), ("2", "highhigh", ["ac", "bd"])]


def field(spark, elim, seeds, prelims=PRELIMS):
    e = event(spark, [*prelims, ("3", "elim", elim)], {x: i + 1 for i, x in enumerate(seeds)} if isinstance(seeds, str) else seeds)
    return B.event_field_stats(*e).first().elim_field


def test_elim_field_and_absent_breakers(spark):
    assert field(spark, ["ab", "c"], "abcd") == 3
    assert field(spark, ["ab", "d"], "abcd") == 4
    assert field(spark, ["ab", "dc"], {"a": 1, "b": 2, "d": 4, "c": 5}) == 4
    low = [("1", "highhigh", ["ac", "bd"]), ("2", "highhigh", ["ab", "dc"])]
    assert field(spark, ["ab", "d"], "abcd", low) == 3


def parts(spark, rounds):
    _, r, b, _ = event(spark, rounds, entries="abcdefgh")
    return {x["name"]: x.bracket for x in B.partition_elim_rounds(r, b).collect()}


def test_brackets_split_by_label_or_by_shared_entries(spark):
    split = [("6", "elim", ["ab", "cd"], "VS"), ("7", "elim", ["ac"], "VF"), ("8", "elim", ["ef"], "NF")]
    assert parts(spark, split) == {"6": "main", "7": "main", "8": "consolation"}
    plain = [("6", "elim", ["ab", "cd"], "Semis"), ("7", "elim", ["ef"], "Finals"), ("8", "final", ["ac"], "Finals")]
    assert parts(spark, plain) == {"6": "main", "7": "consolation", "8": "main"}
    one_family = [("6", "elim", ["ab", "cd"], "VS"), ("7", "elim", ["ac"], "VF")]
    assert parts(spark, one_family) == {"6": "main", "7": "main"}
    missing = [("6", "elim", ["ab", "cd"], ""), ("7", "elim", ["ef"], "N"), ("8", "final", ["ac"], "V")]
    assert parts(spark, missing)["7"] == "consolation"


def test_majority_ties_and_byes(spark, rows):
    e = event(spark, [("1", "highhigh", [{"a": [True, False], "b": [False, True]}, "c"]), ("2", "highhigh", [{"a": [True, True, False], "b": [False, False, True]}, "cd"])])
    rec = rows(B.prelim_record(e[1], e[2]), "entry_id")
    assert (rec["a"]["wins"], rec["a"]["losses"]) == (1, 1) and (rec["b"]["wins"], rec["b"]["losses"]) == (0, 2)
    assert (rec["c"]["wins"], rec["c"]["losses"]) == (2, 0)
    perf = rows(B.entry_performance(*e), "entry_id")
    assert (perf["d"]["wins"], perf["d"]["losses"]) == (0, 2)  # a round without a ballot is a loss


def test_final_depth_promotion_and_closeout(spark, rows):
    split = {"a": [True, True, False], "b": [False, False, True]}
    e = event(spark, [*PRELIMS, ("3", "elim", ["ac", "bd"]), ("4", "final", [split])])
    perf = rows(B.entry_performance(*e), "entry_id")
    assert [perf[x]["elim_level"] for x in "abcd"] == ["first", "second", "semi", "semi"]
    assert perf["a"]["elim_wins"] == 2 and perf["b"]["elim_wins"] == 1
    # Semifinals and no final at all: both winners share the title, and schoolmates pay for it.
    e = event(spark, [*PRELIMS, ("3", "elim", ["ac", "bd"])], schools={"a": "s", "b": "s", "c": "t", "d": "u"})
    perf = rows(B.entry_performance(*e), "entry_id")
    assert perf["a"]["won_final"] and perf["b"]["won_final"]
    assert perf["a"]["walkover_adjustment"] == -3 and perf["c"]["walkover_adjustment"] == 0


def test_walkovers_by_short_panel(spark, rows):
    three = lambda x, y: {x: [True, True, True], y: [False, False, False]}
    e = event(spark, [*PRELIMS, ("3", "elim", [{"a": [True], "c": [False]}, three("b", "d")]), ("4", "final", [three("a", "b")])],
              schools={"a": "s", "c": "s", "b": "t", "d": "u"})
    perf = rows(B.entry_performance(*e), "entry_id")
    assert perf["a"]["walkover_adjustment"] == -2 and perf["c"]["walkover_adjustment"] == 2
    assert perf["b"]["walkover_adjustment"] == 0


def test_missing_round_between_same_school_pairs(spark, rows):
    e = event(spark, [("1", "highhigh", ["ab", "cd", "ef", "gh"]), ("2", "elim", ["ax", "by", "cz", "dw"]), ("4", "final", ["ac"])],
              entries="abcdefghxyzw", schools={"a": "s", "b": "s", "c": "t", "d": "t", "x": "1", "y": "2", "z": "3", "w": "4"})
    perf = rows(B.entry_performance(*e), "entry_id")
    assert [perf[x]["walkover_adjustment"] for x in "abcd"] == [-2, 2, -2, 2]


def test_unscored_final(spark, rows):
    final = {"a": [None], "b": [None]}
    base = [*PRELIMS, ("3", "elim", ["ac", "bd"]), ("4", "final", [final])]
    perf = rows(B.entry_performance(*event(spark, base, schools={"a": "s", "b": "t"})), "entry_id")
    assert [perf[x]["elim_level"] for x in "ab"] == ["second", "second"]
    perf = rows(B.entry_performance(*event(spark, base, schools={"a": "s", "b": "s"})), "entry_id")
    assert [perf[x]["elim_level"] for x in "ab"] == ["first", "first"]
    perf = rows(B.entry_performance(*event(spark, base, schools={"a": "s", "b": "t"}, champions="b")), "entry_id")
    assert [perf[x]["elim_level"] for x in "ab"] == ["second", "first"]


def counted(rounds, ballots):
    """Ballots counted by side, with what their round is."""
    known = rounds.select("event_id", "round_id", "round_pos", "is_prelim", "is_elim")
    return ballots.groupBy("event_id", "round_id", "section_id", "entry_id").agg(
        F.count("*").cast("int").alias("cast"), F.count("won").cast("int").alias("decided"), F.count_if("won").cast("int").alias("won"),
        F.bool_or("is_bye").alias("is_bye")).join(known, ["event_id", "round_id"])


def test_counted_ballots_tell_what_ballots_tell(spark, monkeypatch):
    rounds = [("1", "highhigh", [{"a": [True, False, None], "b": [False, True, None]}, "cd", "e", {"f": [None], "g": [None]}]), ("2", "highhigh", ["ac", "bd", "g"]),
              ("3", "elim", [{"a": [True, True, False], "b": [False, False, True]}, "c"]), ("4", "final", ["ac"]), ("5", "elim", ["fg"])]
    events = [event(spark, rounds, {x: i + 1 for i, x in enumerate("abdc")}, entries="abcdefgh"), event(spark, rounds, entries="abcdefgh", champions="c"),
              event(spark, [*PRELIMS, ("3", "elim", ["ab", "d"])], dict(zip("abcd", range(1, 5))))]
    here = [[d.withColumn("event_id", F.lit(f"e{i}")) for d in e] for i, e in enumerate(events)]
    e = [spark.createDataFrame(one.union(two).union(three).collect(), one.schema) for one, two, three in zip(*here)]
    lean = [e[0], e[1], counted(e[1], e[2]), e[3]]
    perf = B.entry_performance(*e).collect()
    assert sorted(map(tuple, B.entry_performance(*lean).collect())) == sorted(map(tuple, perf))
    fields = sorted(map(tuple, B.event_field_stats(*e, spark.createDataFrame(perf)).collect()))
    # Field sizes need no performance of every entry.
    monkeypatch.setattr(B, "entry_performance", None)
    got = B.event_field_stats(*lean).orderBy("event_id").collect()
    assert sorted(map(tuple, got)) == fields and [x.elim_field for x in got] == [3, 3, 4]
