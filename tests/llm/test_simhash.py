"""SimHash components against a plain reading of their definition."""

import random
import re

import numpy as np
import xxhash

from verdikt.llm import simhash


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_components(rows):
    prints = [(d, plain_print(t)) for d, t in rows]
    top = list(range(len(prints)))

    def root(k):
        return k if top[k] == k else root(top[k])

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j][1]).count("1") <= 2:
                top[root(i)] = root(j)
    lowest = {}
    for k, (d, _) in enumerate(prints):
        if d is not None:
            lowest[root(k)] = min(d, lowest.get(root(k), d))
    return sorted(((d, f"{p:016x}", lowest.get(root(k))) for k, (d, p) in enumerate(prints)), key=str)


def answer(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choices("abcdeÄéß", k=4)) for _ in range(60)]
    rows = [(k, " ".join(rng.choices(pool, k=rng.randint(1, 60)))) for k in range(60)]
    for k in range(40):
        base = rows[k % 8][1].split() * 6
        base[rng.randrange(len(base))] = rng.choice(pool)
        rows.append((100 + k, "\t".join(base)))
    rows += [(3, None), (None, "x y z"), (None, "Q only"), (1, ""), (2, " \n"), (5, rows[0][1]), (5, rows[0][1]), (8, "ONE two"), (9, "one TWO"),
             (10, "long\x1cword kept " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id", "3 as n")
    assert answer(df) == plain_components(rows)


def test_empty_table(spark):
    assert answer(spark.createDataFrame([], "doc_id long, text string")) == []


def test_large_shards_link_alike(spark, monkeypatch):
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")

    def groups():
        from verdikt.operators.graph import connected_components
        found = {}
        for r in connected_components(simhash.fingerprint_links(df)).collect():
            found.setdefault(r.component, set()).add(r.node)
        return sorted(map(sorted, found.values()))

    by_trees = groups()
    monkeypatch.setattr(simhash, "SHARD_ROWS", 4)
    assert groups() == by_trees
    assert max(map(len, by_trees)) > 50


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(7)
    tree, values = simhash.BKTree(), []
    for _ in range(500):
        v = rng.getrandbits(12)
        assert sorted(tree.values[k] for k in tree.within(v, 2)) == sorted(x for x in values if (x ^ v).bit_count() <= 2)
        if v not in values:
            values.append(v)
            tree.add(v)


def test_majority_of_many_hashes():
    rng = np.random.default_rng(8)
    counts = np.array([0, 1, 255, 256, 0, 1300])
    hashes = rng.integers(0, 2**63, counts.sum(), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    got, at = simhash.majority(hashes, counts), 0
    for k, n in enumerate(counts):
        run = [int(h) for h in hashes[at:at + n]]
        at += n
        assert int(got[k]) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in run) * 2 > n and n)
