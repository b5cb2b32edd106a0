"""The prefix trie and its sums against a plain trie, and the parts that let one group hold most rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from verdikt.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, key string, conv string, place int, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    nodes, ends = defaultdict(set), defaultdict(list)
    for c, own in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].add(c)
        ends[path].append(c)
    out = set()
    for node, members in nodes.items():
        below = [n for n in nodes if n[:len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in below)]
        saved = sum((len(nodes[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        out.add((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children), len(leaves), saved,
                 hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return out


def made(seed, convs=60, longest=7):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-45, 150), convs):
        for turn in range(r.randint(1, longest)):
            rows.append((c, r.choice([turn, turn, None]), r.choice(["user", "assistant", None]), r.choice(["hi", "hi there\tyou", "", None, "\x0b x", "ä b c"])))
    return rows + rows[:5] + [(None, 1, "user", "lost")]


def frame(spark, rows):
    return spark.createDataFrame([(*row, "k", "c", 1, 2) for row in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_are_those_of_a_plain_trie(spark, monkeypatch, seed):
    monkeypatch.setattr(prefixes.list_rank, "__defaults__", (8,))
    rows = made(seed)
    got = prefixes.trie(frame(spark, rows)).select(COLUMNS).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain(rows)


def test_one_conversation_and_one_first_turn_hold_most_rows(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 16)
    rows = [(7, k, "user", f"t{k} w") for k in range(300)]
    rows += [(c, k, "user", "hello all") for c in range(1000, 1240) for k in range(2)]
    assert {tuple(r) for r in prefixes.trie(frame(spark, rows)).select(COLUMNS).collect()} == plain(rows)


def test_no_conversations(spark):
    assert prefixes.trie(frame(spark, [])).collect() == []
    assert prefixes.trie(frame(spark, [(None, 1, "a", "b")])).collect() == []


def test_a_list_is_ranked_at_any_limit(spark):
    order = list(range(500))
    random.Random(3).shuffle(order)
    kind = "struct<a: bigint, b: bigint, leaves: boolean>"
    links = spark.createDataFrame([((a, 0, False), (b, 0, False) if b is not None else None) for a, b in zip(order, order[1:] + [None])], f"arc {kind}, next {kind}")
    for rest in (1, 40, 1000):
        got = {r.arc.a: r.left for r in prefixes.list_rank(links, rest).collect()}
        assert got == {a: 500 - k for k, a in enumerate(order)}


def test_digests_of_ends_take_every_piece_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 3)
    ends = spark.range(-20, 100).select(F.struct((F.pmod("id", F.lit(3)) % 2).alias("a"), F.lit(5).cast("long").alias("b")).alias("key"), F.col("id").alias("conv")).repartition(7)
    for row in prefixes.end_digests(ends).collect():
        convs = [c for c in range(-20, 100) if c % 3 % 2 == row.key.a]
        assert row.ends_sha256 == hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()
