import hashlib
import random

import numpy as np

from tessera.llm import fingerprints as fg


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def slow_signs(raw, size, most):
    """The definition, byte by byte."""
    out, start = [], 0
    def sign(part):
        h = 0
        for k, c in enumerate(part):
            h = (h + (c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64)) % (1 << 64)
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % (1 << 64)
        return fg.SIGNS[h >> 58]
    for i in range(len(raw)):
        r = sum((raw[i - k] + 1) * pow(0x01000193, k + 1, 1 << 32) for k in range(min(fg.WINDOW, i + 1))) % (1 << 32)
        r = (r ^ r >> 15) * 0x2C1B3C6D % (1 << 32)
        r ^= r >> 13
        if r % size == size - 1 and len(out) < most - 1:
            out.append(sign(raw[start:i + 1]))
            start = i + 1
    if start < len(raw):
        out.append(sign(raw[start:]))
    return "".join(out)


def test_edit_distances():
    rng = random.Random(3)
    pairs = [("".join(rng.choice("ABC") for _ in range(rng.randrange(65))), "".join(rng.choice("ABC") for _ in range(rng.randrange(65))))
             for _ in range(300)]
    assert fg.edit_distances(pairs).tolist() == [distance(a, b) for a, b in pairs]


def test_signatures_equal_the_definition():
    rng = random.Random(9)
    for n in (0, 1, 3, 6, 7, 8, 50, 400, 3000):
        raw = bytes(rng.randrange(256) for _ in range(n))
        size, first, second = fg.fingerprint(raw).split(":")
        assert first == slow_signs(raw, int(size), 64) and second == slow_signs(raw, 2 * int(size), 32)


def test_likeness_follows_edits():
    rng = random.Random(1)
    text = " ".join(rng.choice(["stone", "river", "bird", "leaf", "moss"]) + str(rng.randrange(1000)) for _ in range(900))
    other = " ".join(str(rng.random()) for _ in range(400))
    a = fg.fingerprint(text.encode())
    one = fg.fingerprint(text.replace("river", "brook", 3).encode())
    quarter = fg.fingerprint(fg.edited(text, other).encode())
    near = fg.likeness([(a, a), (a, one), (a, quarter), (a, fg.fingerprint(other.encode()))])
    assert near[0] == 1 and near[1] > 0.8 and 0.5 < near[2] < 0.95 and near[3] < 0.2
    assert fg.likeness([("3::", "3::"), ("3::", "3:A:B")]).tolist() == [1.0, 0.0]


def check(docs, got):
    order = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    for (i, x), (_, y) in zip(order, order[1:] + order[:1]):
        x, y, r = x or "", y or "", by[i]
        new = fg.edited(x, y)
        assert r["n_chars"] == len(x) and r["edited"] == new
        fx, fe, fy = (fg.fingerprint(t.encode()) for t in (x, new, y))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fx, fe)
        assert np.allclose([r["near_edited"], r["near_next"]], fg.likeness([(fx, fe), (fx, fy)]))


def test_neighbours_equal_brute_force(make):
    rng = random.Random(5)
    docs = [(i * 3, "".join(rng.choice("abc dé🙂") for _ in range(rng.randrange(300)))) for i in range(250)]
    docs += [(10_000, None), (10_001, ""), (10_002, "x" * 100_000), (None, "the last")]
    for blocks in (1, 4, 40):
        check(docs, fg.compare_neighbours(make(docs, 5).withColumnRenamed("lang", "tail"), blocks=blocks).collect())


def test_cases(make, empty):
    assert fg.compare_neighbours(empty).collect() == []
    check([(4, "alone in the table, and so its own successor")], fg.compare_neighbours(make([(4, "alone in the table, and so its own successor")])).collect())
    same = fg.compare_neighbours(make([(1, "same words here")] * 3 + [(2, "b")])).collect()
    assert len(same) == 4 and sum(r["near_next"] == 1.0 for r in same) == 2
    got = fg.with_fingerprints(make([(1, None), (2, "same"), (3, "same")])).collect()
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by[1] == "3::" and by[2] == by[3]


def test_query(spark):
    from tessera.llm.catalog import QUERIES
    from tests.conftest import SF_SMALL
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op10_fingerprints"](spark, SF_SMALL).collect()}
    order = sorted(docs)
    for (i, x), (_, y) in zip(order, order[1:] + order[:1]):
        assert got[i]["edited_sha256"] == hashlib.sha256(fg.edited(x or "", y or "").encode()).hexdigest()
        assert got[i]["fingerprint"] == fg.fingerprint((x or "").encode())
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.6
