"""Exact kNN via the projection band equals brute force, including ties,
duplicates and a hot class."""

import random

from pyspark.sql import functions as F

from tessera.operators import balance as bl


def _brute(rows, k):
    out = {}
    for i, (id1, v1, c1) in enumerate(rows):
        cand = []
        for id2, v2, c2 in rows:
            if c1 == c2 and id1 != id2:
                d = 0.0
                for a, b in zip(v1, v2):
                    d = d + (a - b) * (a - b)
                cand.append((d, id2))
        cand.sort()
        out[id1] = [c[1] for c in cand[:k]]
    return out


def test_knn_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        c = "hot" if i % 3 else f"c{i % 5}"
        v = [float(rnd.randint(0, 6)) for _ in range(3)]   # many exact ties
        rows.append((i, v, c))
    rows.append((1000, list(rows[0][1]), rows[0][2]))      # duplicate point
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    got = {}
    for r in bl.knn_within_class(df, "id", "vec", "label", 5).orderBy("id", "nbr_rank").collect():
        got.setdefault(r.id, []).append(r.nbr_id)
    exp = _brute(rows, 5)
    assert got == {k: v for k, v in exp.items() if v}


def test_knn_restricted_queries(spark):
    rows = [(i, [float(i % 17), float(i % 5)], "a") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    q = spark.createDataFrame([(3,), (40,)], "id long")
    got = bl.knn_within_class(df, "id", "vec", "label", 3, queries=q)
    assert sorted({r.id for r in got.collect()}) == [3, 40]
    assert got.where(F.col("nbr_rank") > 3).count() == 0


def test_knn_group_of_copies(spark):
    # a third of all rows are copies of one point: exact answer, and the
    # candidate side keeps at most k+1 copies
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        if i % 3 == 0:
            rows.append((i, [1.0, 2.0, 3.0], "a"))
        else:
            rows.append((i, [float(rnd.randint(0, 4)), float(rnd.randint(0, 4)), 3.0], "a" if i % 2 else "b"))
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    got = {}
    for r in bl.knn_within_class(df, "id", "vec", "label", 5).orderBy("id", "nbr_rank").collect():
        got.setdefault(r.id, []).append(r.nbr_id)
    exp = _brute(rows, 5)
    assert got == {k: v for k, v in exp.items() if v}


def test_knn_salted_cells_exact(spark):
    # force salting of every cell: results must not change
    rnd = random.Random(11)
    rows = [(i, [rnd.random() for _ in range(6)], "a" if i % 4 else "b") for i in range(240)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    got = {}
    for r in bl.knn_within_class(df, "id", "vec", "label", 5, cell_target=7).orderBy("id", "nbr_rank").collect():
        got.setdefault(r.id, []).append(r.nbr_id)
    assert got == _brute(rows, 5)


def test_knn_far_from_the_origin(spark):
    # spacing 1e-3 on a diagonal, at offsets where a projection rounds by more than that
    for offset in (1e8, 1.7e9):
        rows = [(i, [offset + 1e-3 * i, offset + 1e-3 * i], "a") for i in range(120)]
        df = spark.createDataFrame(rows, "id long, vec array<double>, label string")
        got = {}
        for r in bl.knn_within_class(df, "id", "vec", "label", 5).orderBy("id", "nbr_rank").collect():
            got.setdefault(r.id, []).append(r.nbr_id)
        assert got == _brute(rows, 5)


def test_smote_keeps_string_ids(spark):
    rnd = random.Random(9)
    rows = [(f"row-{i}", [rnd.random(), rnd.random()], "a" if i % 4 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, vec array<double>, label string")
    out = bl.smote(df, "id", "vec", "label").collect()
    ids = {r[0] for r in rows}
    assert sum(r.src == "synth" for r in out) == 30
    assert all(r.base_id in ids and r.nbr_id in ids for r in out if r.src == "synth")
    assert {r.seq for r in out if r.src == "orig"} == ids


def test_pivots_prune_clustered_vectors(spark):
    """64 dimensions, tight clusters: exact, with a small share of the pairs compared."""
    import numpy as np
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 64)) * 10
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=64) * 0.05], "ab"[i % 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string").repartition(5)
    got = {}
    for r in bl.knn_within_class(df, "id", "vec", "label", 5).orderBy("id", "nbr_rank").collect():
        got.setdefault(r.id, []).append(r.nbr_id)
    assert got == _brute(rows, 5)
    share = bl.pairs_compared(df, "id", "vec", "label").first()
    assert share.n_rows == 600 and share.n_pairs == 2 * 300 * 300
    assert share.n_compared < 0.3 * share.n_pairs


def test_knn_of_classless_rows(spark):
    rows = [(1, [0.0], None), (2, [0.1], None), (3, [0.0], "a"), (4, [5.0], "a")]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    got = [(r.id, r.nbr_id) for r in bl.knn_within_class(df, "id", "vec", "label", 5).collect()]
    assert sorted(got) == [(3, 4), (4, 3)]
    assert bl.knn_within_class(df.where("false"), "id", "vec", "label", 5).collect() == []


def test_blocks_and_groups_stay_small(spark, monkeypatch):
    """No Python call of the search holds more rows than its target, whatever the class's
    size and however many cells a query is compared with; the neighbours stay exact."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps
    rnd = random.Random(8)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)], "a") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    real = PandasCogroupedOps.applyInArrow

    def watched(self, func, schema):
        def checked(left, right):
            out = func(left, right)
            assert left.num_rows <= 250 and right.num_rows <= 250 and out.num_rows <= 250 * 6, (func.__name__, left.num_rows, right.num_rows, out.num_rows)
            return out
        return real(self, checked, schema)
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", watched)
    got = {}
    for r in bl.knn_within_class(df, "id", "vec", "label", 5, cell_target=100).orderBy("id", "nbr_rank").collect():
        got.setdefault(r.id, []).append(r.nbr_id)
    assert got == _brute(rows, 5)


def test_a_query_is_sent_once_to_a_block(spark):
    """A query goes to a block of cells once, not to each of its cells, also where nothing can be ruled out."""
    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(24)], "a") for i in range(900)]
    cand = spark.createDataFrame(rows, "_id long, _v array<double>, _c string")
    sent = bl._pivot_pairs(cand, cand, 5, 64, 300).where("nbr_id is null").groupBy("_id").count().collect()
    assert len(sent) == 900 and max(r["count"] for r in sent) <= 900 // 300 + 1


def test_knn_is_exact_far_from_the_origin(spark):
    """Matrix products lose the digits of distances that are small beside the vectors;
    neighbours and distances are those of sums in array order all the same."""
    rnd = random.Random(10)
    rows = [(i, [1e6 + rnd.randint(-3, 3) * 1e-3 for _ in range(4)] + [rnd.gauss(0, 1e-4)], "ab"[i % 2]) for i in range(500)]
    rows += [(1000 + i, [float("nan"), *rows[i][1][1:]], "a") for i in range(3)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string").repartition(3)
    got, dist = {}, {}
    for r in bl.knn_within_class(df, "id", "vec", "label", 5, cell_target=60).orderBy("id", "nbr_rank").collect():
        got.setdefault(r.id, []).append(r.nbr_id)
        dist[r.id, r.nbr_id] = r.dist2
    assert got == _brute(rows[:500], 5)
    by_id = {i: v for i, v, _ in rows}
    for (i, j), d in dist.items():
        want = 0.0
        for a, b in zip(by_id[i], by_id[j]):
            want = want + (a - b) * (a - b)
        assert d == want


def test_rows_that_share_an_id_are_no_neighbours(spark):
    """The nearest rows of other ids, however many rows have the query's."""
    rnd = random.Random(11)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)], "a") for i in range(120)]
    copies = [r for r in rows[::7] for _ in range(rows.index(r) % 6)]
    df = spark.createDataFrame(rows + copies, "id long, vec array<double>, label string").repartition(3)
    exp, got = _brute(rows, 5), {}
    for r in bl.knn_within_class(df, "id", "vec", "label", 5, cell_target=50).collect():
        assert r.nbr_id != r.id
        got.setdefault(r.id, set()).add(r.nbr_id)
    # every copy of a neighbour or of a query counts as a rank
    assert all(v and v == set(exp[i][:len(v)]) for i, v in got.items()) and set(got) == set(range(120))
