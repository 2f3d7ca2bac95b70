import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import substrings


def brute(docs, size):
    """Kept words and the number removed of each document, in the order of ids."""
    seen, out = set(), {}
    for i in sorted(docs):
        words = docs[i].split()
        gone = set()
        for s in range(len(words) - size + 1):
            g = tuple(words[s:s + size])
            if g in seen:
                gone.update(range(s, s + size))
            seen.add(g)
        out[i] = (" ".join(w for p, w in enumerate(words) if p not in gone), len(words), len(gone))
    return out


def test_automaton_equals_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        size = rng.randrange(1, 6)
        alphabet = rng.choice([1, 2, 4])
        contexts = [[rng.randrange(alphabet) for _ in range(rng.randrange(14))] for _ in range(rng.randrange(1, 7))]
        seen, want = set(), []
        for c in contexts:
            want.append([])
            for i in range(len(c) - size + 1):
                if tuple(c[i:i + size]) in seen:
                    want[-1].append(i)
                seen.add(tuple(c[i:i + size]))
        assert substrings.repeated(contexts, size) == want


def corpus(rng):
    words = [f"w{i}" for i in range(60)]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 40))) for _ in range(12)]
    docs = {}
    for i in range(120):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))
                 for _ in range(rng.randrange(1, 6))]
        docs[i * 3] = rng.choice([" ", "\n", "\t "]).join(parts)
    docs[500] = "a " * 300
    docs[501] = "x " + "a " * 40 + "b"
    docs[502] = docs[3]
    return docs


@pytest.mark.parametrize("options", [{}, {"hot_contexts": 0}, {"hot_contexts": 2, "shard_contexts": 3, "filter_bits": 6}, {"seed_words": 3}])
def test_equals_brute_force(make, options):
    docs = corpus(random.Random(2))
    want = brute(docs, 20)
    assert sum(n for _, _, n in want.values()) > 500
    got = {r["doc_id"]: (r["text"], r["n_words"], r["n_removed"])
           for r in substrings.dedup_substrings(make(list(docs.items())), **options).collect()}
    assert got == want


def test_short_windows(make):
    docs = corpus(random.Random(5))
    for size in (1, 4):
        got = {r["doc_id"]: (r["text"], r["n_words"], r["n_removed"])
               for r in substrings.dedup_substrings(make(list(docs.items())), min_words=size).collect()}
        assert got == brute(docs, size)
    with pytest.raises(ValueError):
        substrings.dedup_substrings(make([(1, "a")]), min_words=0)


def test_the_automaton_decides(make, monkeypatch):
    """Spans that only the automaton finds: texts around a shared passage differ, so no context is a copy."""
    passage = " ".join(f"p{i}" for i in range(21))
    docs = {i: " ".join(f"a{i}x{k}" for k in range(30)) + f" {passage} " + " ".join(f"b{i}x{k}" for k in range(30)) for i in range(4)}
    contexts = [d.split() for d in docs.values()]
    assert [len(x) for x in substrings.repeated(contexts, 20)] == [0, 2, 2, 2]
    assert {k: v[2] for k, v in brute(docs, 20).items()} == {0: 0, 1: 21, 2: 21, 3: 21}
    got = {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(make(list(docs.items()))).collect()}
    assert got == {0: 0, 1: 21, 2: 21, 3: 21}


def test_cases(make, empty):
    passage = " ".join(f"word{k}" for k in range(50))
    rows = [(1, f"start {passage} end"), (2, passage), (2, passage), (3, None), (4, ""), (5, " \n\t"), (None, f"mine {passage}"),
            (6, "few  words\there"), (7, "é " * 3 + passage + " glued"), (8, "x " * 400_000), (9, f"A {passage}"), (9, f"B {passage}")]
    df = make(rows).withColumns({c: F.lit("kept") for c in ("n_removed", "th", "id", "t", "row", "starts", "m", "a.b")})
    got = {}
    for r in substrings.dedup_substrings(df).collect():
        assert r["th"] == r["row"] == r["a.b"] == r["m"] == "kept" and r["lang"] == "en"
        got.setdefault(r["doc_id"], []).append((r["text"], r["n_words"], r["n_removed"]))
    assert got[1] == [(rows[0][1], 52, 0)] and got[2] == [("", 50, 50)] * 2 and got[3] == [(None, 0, 0)]
    assert got[4] == got[5] == [("", 0, 0)] and got[None] == [("mine", 51, 50)] and got[6] == [("few words here", 3, 0)]
    assert got[7] == [("é é é word49 glued", 53, 49)]
    assert got[8] == [("x", 400_000, 399_999)]         # the window at the second word repeats the first one
    assert sorted(got[9]) == [("A", 51, 50), ("B", 51, 50)]
    assert substrings.dedup_substrings(empty).collect() == []
    text_ids = make(rows[:2]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(text_ids).collect()} == {"d1": 0, "d2": 50}
