import random

import numpy as np
import xxhash

from tessera.llm import simhash
from tests.conftest import SF_SMALL


def plain(text, k):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute(prints, bits):
    """prints: id to fingerprint; smallest id reachable."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_equals_the_definition():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aBZé \t\n\x0b\x85z") for _ in range(rng.randrange(0, 60)))
        assert simhash.fingerprint(text, 4) == plain(text, 4)
    assert simhash.fingerprint(None, 4) == simhash.fingerprint(" \n", 4) == 0


def test_links_equal_brute_force(spark):
    rng = random.Random(7)
    prints = {}
    for i in range(400):
        if prints and rng.random() < 0.6:
            v = prints[rng.choice(list(prints))]
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                v ^= 1 << b
        else:
            v = rng.getrandbits(64)
        prints[i] = v
    df = spark.createDataFrame([(i, int(np.uint64(v).astype(np.int64))) for i, v in prints.items()], "id long, fp long").repartition(5)
    from tessera.llm.components import components
    for bits, segments in ((4, 3), (3, 3), (4, 4), (2, 2)):
        links = simhash.fingerprint_links(df, "fp", bits, segments)
        comp = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}
        fps = {i: int(np.uint64(v).astype(np.int64)) for i, v in prints.items()}
        want = brute(prints, bits)
        got = {}
        for i, f in fps.items():
            got.setdefault(comp.get(f, f), []).append(i)
        assert sorted(sorted(v) for v in got.values()) == sorted(
            sorted(i for i in want if want[i] == r) for r in set(want.values()))


def test_near_duplicates_cases(make, empty):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w7 ", "x7 ")
    rows = [(5, base), (3, base), (9, near), (9, near), (11, None), (12, ""), (13, " \n"), (None, base), (20, "quite another text here")]
    got = simhash.near_duplicates(make(rows).withColumnRenamed("lang", "fp"), shingle_words=4, max_bits=64 // 4, segments=6).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[5] == by[3] == 3 and by[9] == 3 and by[11] == by[12] == by[13] == 11 and by[20] == 20 and by[None] is None
    assert simhash.near_duplicates(empty).collect() == []


def test_large_group_leaves_a_forest_only(spark):
    rng = np.random.default_rng(3)
    centre = np.uint64(0x0123456789ABCDEF)
    prints = np.unique(centre ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    links = simhash.fingerprint_links(df, "fp", 4, 3)
    n = links.count()
    assert len(prints) - 1 <= n <= 3 * (1 + 64) * simhash.SALTS * len(prints)
    assert n < len(prints) ** 2 / 4
    from tessera.llm.components import components
    assert components(links, "a", "b").select("component").distinct().count() == 1


def test_query_equals_brute_force(spark):
    from tessera.llm.catalog import QUERIES
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op5_simhash_near_dedup"](spark, SF_SMALL).collect()}
    prints = {i: plain(t, 4) for i, t in docs.items()}
    want = brute(prints, 4)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", want[i]) for i in docs}
