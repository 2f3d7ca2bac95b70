import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours
from tests.conftest import SF_MID


def brute(ids, x, q, k):
    s = x @ x[q]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), s[i]) for i in order]


def test_recall_of_the_query(spark):
    from tessera.llm.catalog import QUERIES
    rows = spark.read.parquet(f"{SF_MID}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = {}
    for r in QUERIES["op9_nearest_neighbours"](spark, SF_MID).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [int(i) for i in ids if i % 20 == 0]
    recall = []
    for q, near in got.items():
        near.sort()
        want = brute(ids, x, int(np.flatnonzero(ids == q)[0]), 20)
        recall.append(len({v for _, v, _ in near} & {v for v, _ in want}) / 20)
        assert [r for r, _, _ in near] == list(range(1, 21))
        assert [(-s, v) for _, v, s in near] == sorted((-s, v) for _, v, s in near)
        for _, v, s in near:
            assert abs(s - x[ids == v][0] @ x[ids == q][0]) < 1e-12
    assert np.mean(recall) >= 0.9


@pytest.mark.parametrize("block_rows", [64, 8192])
def test_whole_share_is_exact(spark, block_rows):
    """With the whole index below the prefixes the forest is exact: norms, copies, ties, odd vectors."""
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(v) for v in rng.integers(-3, 4, 6)]) for i in range(300)]
    rows += [(1000 + i, [3.0, 3.0, 0.0, 0.0, 0.0, 1.0]) for i in range(90)]
    odd = [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] + [1.0] * 5), (2004, [float("inf")] + [1.0] * 5),
           (2005, [1.0, 2.0]), (None, [1.0] * 6), (2006, []), (7, rows[7][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("g", F.lit(1)).repartition(6)
    ok = [(i, v) for i, v in rows if any(v)]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 5 == 0, k=7, trees=3, share=3.0, block_rows=block_rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [int(i) for i in ids if i % 5 == 0]
    for q, near in got.items():
        want = brute(ids, x, int(np.flatnonzero(ids == q)[0]), 7)
        assert [v for _, v, _ in sorted(near)] == [v for v, _ in want]


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    got = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (3, [2.0, -1.0])], schema), F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 3), (0, 2, 1)]
    assert neighbours.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).collect() == []
    assert neighbours.nearest(spark.createDataFrame([(20, [1.0, 0.0])], schema), F.col("vec_id") % 20 == 0).collect() == []
