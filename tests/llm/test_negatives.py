import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives


def brute(rows, step=100, low=(30, 100), high=(90, 100), k=5, n=10):
    out = set()
    for a, la, q in (r for r in rows if r[0] % step == 0):
        score = {i: sum(x * y for x, y in zip(q, v)) for i, _, v in rows}
        label = {i: lab for i, lab, _ in rows}
        ranked = sorted((i for i in score if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in ranked if label[i] == la][:k]:
            fit = [i for i in ranked if label[i] != la and low[0] * score[p] <= low[1] * score[i] and high[1] * score[i] <= high[0] * score[p]]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fit[:n])}
    return out


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "vec_id long, label int, v array<long>").repartition(parts)


def got(df):
    return {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect()}


def clustered(seed, n=600, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * rng.choice([40, 200, 3000], size=(12, 1))
    v = np.rint(centres[rng.integers(12, size=n)] + rng.normal(size=(n, dim)) * 15).astype(int)
    return [(int(i * 5), int(rng.integers(4)), [int(x) for x in v[i]]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"pilot": 3, "block_rows": 50, "anchor_rows": 2}])
def test_equals_brute_force(spark, options):
    rows = clustered(3)
    rows += [(100_000 + i, i % 3, rows[0][2]) for i in range(40)]          # ties and copies
    rows += [(200_000 + i, 1, [0] * 8) for i in range(5)]
    want = brute(rows)
    assert len(want) > 500
    assert got(negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0, **options)) == want


def test_ranges_lose_nothing_and_prune():
    rows = clustered(7, 2000)
    v = np.array([r[2] for r in rows])
    bucket = np.floor(np.log2(np.linalg.norm(v, axis=1)) * 4)
    v = v[bucket == np.bincount(bucket.astype(int)).argmax()]               # one length bucket, as in a task
    block = negatives.Block(np.arange(len(v)), np.zeros(len(v), int), v)
    left = total = 0
    for q in v[::10]:
        norm, scores = float(np.sqrt((q * q).sum())), v @ q
        for share in (0.2, 0.5, 0.8):
            least = float(np.quantile(scores, 1 - share / 10))
            if least <= 0:
                continue
            rows_left = block.candidates(q.astype(float), norm, least)
            kept = np.arange(len(v)) if rows_left is None else rows_left
            assert set(np.flatnonzero(scores >= least)) <= set(kept.tolist())
            left, total = left + len(kept), total + len(v)
    assert left < 0.5 * total
    q = v[0].astype(float)
    assert len(block.candidates(q, float(np.linalg.norm(q)), 1e12)) == 0


def test_cases(spark):
    odd = [(100, 1, [3, 4]), (101, 1, [3]), (102, 2, []), (103, None, [1, 1]), (104, 1, None), (None, 1, [5, 5]), (105, 2, [1, None]),
           (106, 2, [2, 3]), (106, 2, [2, 3]), (106, 3, [9, 9]), (200, 5, [7, 7]), (300, 1, [-3, -4])]
    used = [(100, 1, [3, 4]), (101, 1, [3, 0]), (102, 2, [0, 0]), (106, 2, [2, 3]), (200, 5, [7, 7]), (300, 1, [-3, -4])]
    df = frame(spark, odd).withColumn("bucket", F.lit("x")).withColumn("id", F.lit("y"))
    want = brute(used)
    assert got(negatives.mine(df, F.col("vec_id") % 100 == 0)) == want
    wide = [(0, 1, [2, 2]), (1, 1, [10, 0]), (2, 2, [5, 4]), (3, 2, [4, 4]), (4, 2, [30, 0])]
    assert (0, 1, 1, 2, 20, 18) in got(negatives.mine(frame(spark, wide), F.col("vec_id") % 100 == 0))
    assert got(negatives.mine(frame(spark, []), F.col("vec_id") % 100 == 0)) == set()
    huge = [(0, 1, [2 ** 40, 1]), (1, 1, [2 ** 22, 5]), (2, 2, [2 ** 21, 3]), (3, 2, [2 ** 21, 4])]
    assert got(negatives.mine(frame(spark, huge), F.col("vec_id") == 0)) == brute(huge)
    x = spark.createDataFrame([([0.1, -0.001],), ([1.0, None],), ([float("nan")],), ([float("inf")],), (None,), ([],), ([1e30],)], "e array<float>")
    assert [r[0] for r in x.select(negatives.integers(F.col("e"), 256.0)).collect()] == [[25, -1], None, None, None, None, [], [2 ** 62]]
