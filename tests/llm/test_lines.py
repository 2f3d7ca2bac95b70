import random

from pyspark.sql import functions as F

from tessera.llm import linededup


def blocks(docs, min_words):
    """Each document against every earlier one: every run of lines, in any place and order."""
    seqs = {i: [(p, x.rstrip(" "), len(x.split())) for p, x in enumerate(t.split("\n")) if x.split()] for i, t in docs.items()}
    out = {i: set() for i in docs}
    for i in docs:
        for a in (a for a in docs if a < i):
            for s in range(len(seqs[i])):
                for t in range(len(seqs[a])):
                    n = 0
                    while s + n < len(seqs[i]) and t + n < len(seqs[a]) and seqs[i][s + n][1] == seqs[a][t + n][1]:
                        n += 1
                    if sum(w for _, _, w in seqs[i][s:s + n]) >= min_words:
                        out[i] |= {p for p, _, _ in seqs[i][s:s + n]}
    return out


def test_patience_diff():
    assert linededup.aligned([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert linededup.aligned([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert linededup.aligned([], [1]) == []
    assert linededup.aligned([5, 1, 5, 2, 5], [5, 2, 5]) == [(0, 0), (3, 1), (4, 2)]
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(9))] for _ in range(2))
        got = linededup.aligned(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p < q and r < s for (p, r), (q, s) in zip(got, got[1:]))


def test_equals_brute_force(make):
    rng = random.Random(11)
    lines = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 14))) for _ in range(40)]
    docs = {i: "\n".join(rng.choice(lines) if rng.random() < 0.5 else rng.choice(["", f"own line {i} {k} of this one"])
                         for k in range(rng.randrange(1, 15))) for i in range(60)}
    want = blocks(docs, 10)
    got = linededup.dedup_lines(make(list(docs.items()))).collect()
    assert sum(map(len, want.values())) > 10
    for r in got:
        kept = [x for p, x in enumerate(docs[r["doc_id"]].split("\n")) if p not in want[r["doc_id"]]]
        assert r["n_removed"] == len(want[r["doc_id"]])
        emptied = want[r["doc_id"]] and not "".join(kept).strip()
        assert r["text"] == ("" if emptied else "\n".join(kept))


def test_cases(make, empty):
    passage = "\n".join(f"line {k} of a passage that several documents hold in full and in order" for k in range(5))
    rows = [(1, f"start\n{passage}\nend"), (2, f"other\n{passage}"), (3, passage), (3, passage), (4, None), (5, ""), (6, "\n\n"),
            (None, f"mine\n{passage}"), (7, "a short line"), (8, "a short line"), (9, "x " * 200_000)]
    got = linededup.dedup_lines(make(rows).withColumn("n_removed", F.lit("x")).withColumnRenamed("lang", "h")).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["text"], r["n_removed"]))
    assert len(got) == len(rows)
    assert by[1] == [(f"start\n{passage}\nend", 0)] and by[2] == [("other", 5)] and by[3] == [("", 5), ("", 5)]
    assert by[4] == [(None, 0)] and by[5] == [("", 0)] and by[6] == [("\n\n", 0)] and by[None] == [("mine", 5)]
    assert by[7] == by[8] == [("a short line", 0)] and by[9] == [("x " * 200_000, 0)]
    assert linededup.dedup_lines(empty).collect() == []


def test_frequent_short_lines(make):
    """A passage of lines under min_words goes whatever its number of holders."""
    verse = "\n".join(f"verse {k} has eight words in its line" for k in range(8))
    rows = [(i, f"own opening {i}\n{verse}\nown ending {i}") for i in range(120)] + [(i, verse) for i in range(200, 260)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.dedup_lines(make(rows)).collect()}
    assert got[0] == (rows[0][1], 0)
    assert all(got[i] == (f"own opening {i}\nown ending {i}", 8) for i in range(1, 120))
    assert all(got[i] == ("", 8) for i in range(200, 260))


def test_every_block_of_any_earlier_document(make):
    rng = random.Random(5)
    lines = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 12))) for _ in range(14)]
    docs = {i: "\n".join(rng.choice(lines) if rng.random() < 0.8 else rng.choice(["", f"own line {i} {k}"])
                         for k in range(rng.randrange(1, 20))) for i in range(50)}
    a, b, c, d = (f"{x} and four more words" for x in "abcd")
    docs |= {100: a, 101: b, 102: c, 103: d,                                    # each line has its own first holder
             105: f"{a}\n{b}\n{c}", 109: f"x\n{a}\n{b}\n{c}", 110: f"{c}\n{d}\n{a}\n{b}",
             111: f"{a}\n{b}\n{a}\n{b}\n{d}", 112: f"{c}\n{d}\n\n{a}\n{a}\n{b}"}
    want = blocks(docs, 10)
    assert want[109] == {1, 2, 3} and want[110] == {2, 3} and want[111] == {0, 1, 2, 3} and want[112] == {0, 1, 3, 4, 5}
    for r in linededup.dedup_lines(make(list(docs.items()))).collect():
        kept = [x for p, x in enumerate(docs[r["doc_id"]].split("\n")) if p not in want[r["doc_id"]]]
        assert r["n_removed"] == len(want[r["doc_id"]])
        assert r["text"] == ("" if want[r["doc_id"]] and not "".join(kept).strip() else "\n".join(kept))
