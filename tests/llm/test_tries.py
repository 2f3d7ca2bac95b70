import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import tries

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(seqs):
    """seqs: {conv: [(role, text)]} -> multiset of node rows."""
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def frame(spark, convs, parts=4):
    rows = [(c, k, r, t) for c, s in convs.items() for k, (r, t) in enumerate(s)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=str)


def some(seed, n=150, words=3, longest=9):
    rng = random.Random(seed)
    return {c: [(rng.choice("ua"), rng.choice(["", "é", "hello there"][:words])) for _ in range(rng.randrange(1, longest))] for c in range(n)}


def test_query_equals_brute_force(spark):
    convs = some(3)
    seqs = tries.sequences(frame(spark, convs), group=F.col("c") - F.col("c") % 5)
    got = tries.nodes(tries.rebuilt(seqs, F.crc32(F.col("c").cast("string")) % 9, most=8))
    assert rows_of(got) == brute(rebuild(convs))


@pytest.mark.parametrize("shard_turns", [7, 200])
def test_shards_recombine(spark, shard_turns):
    """Copies over many shards, one deep conversation and its copies, prefixes of all lengths."""
    convs = some(5, 60, 2, 5)
    convs |= {c: [("u", "same"), ("a", "reply")] for c in range(1000, 1080)}
    convs |= {c: [("u", "same"), ("a", "reply"), ("u", f"own {c}")] for c in range(2000, 2030)}
    deep = [("u", str(k % 3)) for k in range(70)]
    convs |= {3000: deep, 3001: deep, 3002: deep[:50], 3003: deep[:50] + [("a", "z")]}
    got = tries.nodes(tries.sequences(frame(spark, convs)).select("c", "seq"), shard_turns=shard_turns)
    assert rows_of(got) == brute(convs)


@pytest.mark.parametrize("cells", [1, 40, 10_000])
def test_blocks_of_columns(cells):
    rng = np.random.default_rng(2)
    seqs = [rng.integers(1, 3, rng.integers(0, 30)).tolist() for _ in range(40)]
    flat = np.array([x for s in seqs for x in s])
    got = tries.levels(np.arange(40), np.array([len(s) for s in seqs]), flat, np.ones(len(flat), int), cells)
    for d, own in enumerate(got):
        want = sorted({tuple(s[:d]) for s in seqs if len(s) >= d})
        assert [tuple(seqs[r][:d]) for r in own["first"]] == want
        assert own["n"].tolist() == [sum(tuple(s[:d]) == w and len(s) >= d for s in seqs) for w in want]


def test_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, None, "u", "first"), (1, 0, None, "x"), (1, 1, "a", None), (1, 1, "a", None), (2, 5, "u", "first"), (None, 0, "u", "lost"), (-3, 0, "u", "first")]
    df = spark.createDataFrame(rows, schema).withColumn("shard", F.lit("s")).withColumn("c", F.lit(1))
    want = {1: [("u", "first"), ("", "x"), ("a", ""), ("a", "")], 2: [("u", "first")], -3: [("u", "first")]}
    assert rows_of(tries.nodes(tries.sequences(df))) == brute(want)
    assert tries.nodes(tries.sequences(spark.createDataFrame([], schema))).collect() == []
    turnless = {c: [("u", "a")] for c in (6, 7, 8, 11)}                  # shorter than their heads, no base
    seqs = tries.sequences(frame(spark, turnless), group=F.col("c") - F.col("c") % 5)
    got = rows_of(tries.nodes(tries.rebuilt(seqs, F.lit(3), most=8)))
    assert got == brute({c: [] for c in turnless}) and got[0][1:5] == (0, None, 4, 0)
    long = {1: [("u", "é" * 100_000)], 2: [("u", "é" * 100_000)]}
    assert {r[6] for r in rows_of(tries.nodes(tries.sequences(frame(spark, long))))} == {200_000}
