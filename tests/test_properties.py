"""Properties of the hash-driven split, folds, ordinals, scaler and SMOTE."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import balance as bl, prep, split as sp
from tessera.operators.ordinal import exact_quantiles, rank_within
from tessera.plans.views import Views
from tests.conftest import SF_MID, SF_SMALL


def test_split_sizes_and_disjoint(spark):
    v = Views(spark, SF_MID).v_tab()
    s = sp.train_test_split(v, "id")
    n = v.count()
    test = s.where("split = 'test'").count()
    assert test == math.ceil(0.2 * n)
    assert s.select("id").distinct().count() == n


def test_ordinals_do_not_depend_on_partitioning(spark):
    v = Views(spark, SF_SMALL).v_cls()
    res = []
    for parts in (1, 3, 8):
        r = rank_within(v.select("id", "label"), ["id"], ["label"], partitions=parts)
        res.append(sorted((x.id, x._rank) for x in r.collect()))
    assert res[0] == res[1] == res[2]
    # ranks are 0..n-1 within each label
    r = rank_within(v.select("id", "label"), ["id"], ["label"])
    chk = r.groupBy("label").agg(F.min("_rank").alias("lo"), F.max("_rank").alias("hi"), F.count("*").alias("n"))
    for row in chk.collect():
        assert row.lo == 0 and row.hi == row.n - 1


def test_skewed_group_ranks(spark):
    # one key holds half of all rows: ranks stay exact
    df = spark.range(0, 4000).withColumn("g", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7))
    r = rank_within(df, ["id"], ["g"], partitions=6)
    from pyspark.sql import Window
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1)
    bad = r.join(ref, ["id", "g"]).where(F.col("rn") != F.col("_rank")).count()
    assert bad == 0


def test_exact_quantiles_match_percentile(spark):
    df = spark.range(0, 2001).withColumn("g", (F.col("id") % 3).cast("int")).withColumn("v", F.sin("id") * 100)
    q = exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.9]).collect()
    ref = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", [0.25, 0.5, 0.9]).alias("p")).collect()}
    for row in q:
        exp = ref[row.g][[0.25, 0.5, 0.9].index(row.p)]
        assert abs(row.q - exp) < 1e-9


def test_fold_class_counts_balanced(spark):
    v = Views(spark, SF_MID).v_cls()
    f = sp.stratified_folds(v, "id", "label", 5)
    counts = f.groupBy("label", "fold").count().collect()
    by = {}
    for r in counts:
        by.setdefault(r.label, []).append(r["count"])
    for lab, cs in by.items():
        assert max(cs) - min(cs) <= 1, lab


def test_scaled_train_is_standard(spark):
    v = Views(spark, SF_MID).v_tab()
    cols = ["f_acctbal", "f_n", "f_spend"]
    s = sp.train_test_split(v, "id")
    med = prep.impute_fit(s.where("split = 'train'"), cols)
    imp = prep.impute_transform(s, med, cols)
    p = prep.scale_fit(imp.where("split = 'train'"), cols)
    z = prep.scale_transform(imp, p, cols).where("split = 'train'")
    row = z.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    for i in range(len(cols)):
        assert abs(row[f"m{i}"]) < 1e-9
        assert abs(row[f"s{i}"] - 1) < 1e-9


def test_zero_variance_scale_is_one(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    p = prep.scale_fit(df, ["x"]).first()
    assert p.std == 0.0 and p.scale == 1.0


def test_smote_balances_and_interpolates(spark):
    v = Views(spark, SF_SMALL).v_cls()     # has a class of two rows
    out = bl.smote(v, "id", "vec", "label", 5)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert len(set(counts.values())) == 1
    # every synthetic row lies on the segment between its base and neighbour
    base = v.select(F.col("id").alias("base_id"), F.col("vec").alias("bv"))
    nbr = v.select(F.col("id").alias("nbr_id"), F.col("vec").alias("nv"))
    syn = out.where("src = 'synth'").join(base, "base_id").join(nbr, "nbr_id")
    for r in syn.collect():
        ts = [(x - b) / (n - b) for x, b, n in zip(r.vec, r.bv, r.nv) if abs(n - b) > 1e-9]
        assert all(-1e-9 <= t <= 1 + 1e-9 for t in ts)
        if ts:
            assert max(ts) - min(ts) < 1e-6


def test_smote_strict_raises_on_tiny_class(spark):
    v = Views(spark, SF_SMALL).v_cls()
    with pytest.raises(ValueError):
        bl.smote(v, "id", "vec", "label", 5, strict=True)


def test_label_encode_unknown_raises(spark):
    idx = spark.createDataFrame([("a", 0)], "label string, idx int")
    df = spark.createDataFrame([("b",)], "label string")
    with pytest.raises(Exception):
        prep.label_encode(df, "label", idx).collect()


def test_approx_quantiles_close(spark):
    from tessera.operators.profile import column_medians
    df = spark.range(0, 5000).withColumn("x", F.col("id") * 1.0)
    ex = column_medians(df, ["x"]).first().median
    ap = column_medians(df, ["x"], method="approx").first().median
    assert ex == 2499.5 and abs(ap - ex) <= 1.0


def test_exact_quantiles_equal_percentile(spark):
    # a value that nine tenths of the rows share, nulls and NaN, and a group of one
    df = spark.range(0, 3001).withColumn("g", F.when(F.col("id") == 7, 99).otherwise((F.col("id") % 4)).cast("int")).withColumn(
        "v", F.when(F.col("id") % 10 != 0, 0.0).when(F.col("id") % 50 == 0, F.lit(float("nan")))
        .when(F.col("id") % 70 == 0, None).otherwise(F.cos("id") * 7))
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    a = {(r.g, r.p): r.q for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    clean = df.where(~F.isnan("v") & F.col("v").isNotNull())
    b = {(r.g, p): q for r in clean.groupBy("g").agg(F.percentile("v", probs).alias("q")).collect() for p, q in zip(probs, r.q)}
    one = {r.p: r.q for r in exact_quantiles(df, [], "v", probs).collect()}
    all_of = dict(zip(probs, clean.agg(F.percentile("v", probs)).first()[0]))
    assert one.keys() == all_of.keys() and all(abs(one[p] - all_of[p]) < 1e-9 for p in probs)
    assert a.keys() == b.keys()
    assert all(abs(a[key] - b[key]) < 1e-9 for key in a)


def test_correlation_does_not_depend_on_the_width(spark):
    import tessera.operators.profile as pf
    base = spark.range(0, 200).select((F.sin("id") * 3).alias("x"), F.lit(5.0).alias("const"),
                                      (F.cos("id") * 1e-17).alias("tiny"), F.when(F.col("id") % 3 != 0, F.col("id") * 1.0).alias("gaps"))
    narrow = {(r.col_a, r.col_b): r.corr for r in pf.correlation_matrix(base, base.columns).collect()}
    wide = base.select("*", *[(F.sin(F.col("x") * (i + 1))).alias(f"w{i}") for i in range(56)])
    got = {(r.col_a, r.col_b): r.corr for r in pf.correlation_matrix(wide, wide.columns).collect()}
    assert len(got) == 60 * 60 and all(got[k] == v or abs(got[k] - v) < 1e-12 for k, v in narrow.items() if v is not None)
    assert all(got[k] is None for k, v in narrow.items() if v is None)
    assert narrow[("const", "const")] is None and got[("const", "x")] is None



def test_end_to_end_eval_fuses_whole_signals(spark, monkeypatch):
    """The audio part of the fused vectors is the 13 MFCC means over all points of a signal."""
    import numpy as np
    from tessera.functions import media as md
    from tessera.plans import evaluation as ev
    from tessera.plans.catalog import model_queries as mq

    class Seen(Exception):
        pass

    def prepare(df, id_col, vec, label):
        raise Seen(df.select(id_col, vec).collect())
    monkeypatch.setattr(ev, "prepare", prepare)
    with pytest.raises(Seen) as seen:
        mq.q_end_to_end_eval(spark, SF_SMALL)
    v = Views(spark, SF_SMALL)
    signals = [np.array(r.sig) for r in v.v_sig().orderBy("id").collect()]
    width = len(v.v_img().first().vec)
    rows = seen.value.args[0]
    assert len(rows) > 1 and len({len(r.vec) for r in rows}) == 1
    for r in rows:
        y = signals[r.id] - signals[r.id].mean()
        want = md.mfcc_mean(y / (np.abs(y).max() + 1e-12), 16000, 13, 32, 8, 20)
        assert np.allclose(r.vec[width:width + 13], want, atol=1e-6)


def test_quantiles_by_selection(spark):
    """Continuous, tied, signed, huge and tiny values, with ranges refined many times."""
    import numpy as np
    from tessera.operators.ordinal import exact_quantiles
    rng = np.random.default_rng(5)
    groups = {"flat": rng.uniform(size=3000), "wide": np.exp(rng.normal(size=2500) * 200) * rng.choice([-1, 1], 2500),
              "tied": np.concatenate([np.full(4000, 7.5), rng.uniform(7, 8, 1000)]), "near": 1.0 + np.arange(500) * 2.0 ** -52,
              "odd": np.array([float("-inf"), -1e308, -0.0, 0.0, 5e-324, 1e308, float("inf")]), "one": np.array([3.0]), None: rng.normal(size=700)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("flat", None), ("flat", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for limit, bins in ((100_000, 1024), (3, 4)):
        got = {(r.g, r.p): r.q for r in exact_quantiles(df, ["g"], "v", probs, limit=limit, bins=bins).collect()}
        assert len(got) == len(groups) * len(probs)
        for g, v in groups.items():
            if g == "odd":
                assert [got[(g, p)] for p in (0.0, 0.5, 1.0)] == [float("-inf"), 0.0, float("inf")]
                continue
            for p in probs:
                x = np.sort(v)
                pos = (len(x) - 1) * p
                lo, hi = int(np.floor(pos)), int(np.ceil(pos))
                want = x[lo] if lo == hi else (hi - pos) * x[lo] + (pos - lo) * x[hi]
                assert got[(g, p)] == want, (g, p)


def test_selection_shuffles_counts_only(spark):
    """A hundred thousand different values: what is shuffled is a few thousand bin counts and one range."""
    from tessera.operators.ordinal import _coarse
    df = spark.range(100_000).select((F.col("id") * 0.37 - 9000).alias("v"))
    assert df.select(_coarse(F.col("v")).alias("b")).distinct().count() < 1500


def test_array_moments_skip_missing(spark):
    from tessera.operators import prep
    df = spark.createDataFrame([([1.0, None, 5.0],), ([3.0, 2.0],), (None,), ([5.0, 4.0, 5.0],), ([],)], "v array<double>").repartition(3)
    got = {r.pos: (r.mean, round(r.std, 9), round(r["scale"], 9)) for r in prep.array_scale_fit(df, "v").collect()}
    assert got == {0: (3.0, round((8 / 3) ** 0.5, 9), round((8 / 3) ** 0.5, 9)), 1: (3.0, 1.0, 1.0), 2: (5.0, 0.0, 1.0)}


def test_broadcast_only_if_small(spark):
    from tessera.operators.joins import broadcast_checked, read_if_small
    small = spark.createDataFrame([(1, "a", None), (2, None, [1.5])], "k long, s string, v array<double>")
    got = broadcast_checked(small)
    assert got.schema == small.schema and sorted(got.collect(), key=str) == sorted(small.collect(), key=str)
    assert read_if_small(spark.range(20), max_rows=10) is None
    assert read_if_small(spark.createDataFrame([("x" * 5000,)], "s string")) is None
    assert broadcast_checked(spark.createDataFrame([], "k long")).collect() == []


def test_gram_tiles(spark, monkeypatch):
    """Wide tables with missing values: as numpy has it; tasks hand on tiles, not pairs; merged in a tree."""
    import numpy as np
    from tessera.operators import profile as pf
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 70)) + 1e6 * (np.arange(70) % 3 == 0)
    x[:, 5], x[rng.uniform(size=x.shape) < 0.1] = 3.25, np.nan
    cols = [f"x{i}" for i in range(70)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in x], ", ".join(f"{c} double" for c in cols)).repartition(70)
    monkeypatch.setattr(pf, "FAN_IN", 8)                            # 70 tasks, nine groups
    tiles = pf.gram_tiles(df, cols).collect()
    assert sorted((t.bi, t.bj) for t in tiles) == [(0, 0), (0, 1), (1, 1)]
    assert sum(len(t.tile) for t in tiles) == 6 * 8 * (64 * 64 + 64 * 6 + 6 * 6)
    got = {(r.col_a, r.col_b): r.corr for r in pf.correlation_matrix(df, cols).collect()}
    assert len(got) == 4900
    for a in range(0, 70, 7):
        for b in range(70):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            if 5 in (a, b):
                assert got[(cols[a], cols[b])] is None
            else:
                assert abs(got[(cols[a], cols[b])] - np.corrcoef(x[both, a], x[both, b])[0, 1]) < 1e-9


def test_running_maximum_over_range_partitions(spark):
    import random
    from tessera.operators.ordinal import running_before
    rng = random.Random(9)
    rows = [(i, rng.choice([None, rng.uniform(0, 1 + i / 200)])) for i in range(500)]
    df = spark.createDataFrame(rng.sample(rows, 500), "i int, v double")
    out = running_before(df, ["i"], "v", "before")
    best, want = None, {}
    for i, v in rows:
        want[i] = best
        best = v if best is None or (v is not None and v > best) else best
    assert {r.i: r.before for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_pid" in plan and "windowspecdefinition(i#" not in plan
    assert running_before(df.where("false"), ["i"], "v", "b").collect() == []
    sums = running_before(df, ["i"], "v", "s", aggregate=F.count, merge=lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    assert {r.i: r.s for r in sums.collect()}[499] == sum(v is not None for _, v in rows[:-1])
