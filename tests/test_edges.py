"""Edge cases of documented behaviours."""

import math

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import prep, profile as pf
from tessera.operators import split as sp


def test_impute_all_missing_column_flagged(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, None)], "id int, a double, b double")
    p = {r.feature: r for r in prep.impute_fit(df, ["a", "b"]).collect()}
    assert p["a"].median == 2.0 and not p["a"].all_missing
    assert p["b"].median == 0.0 and p["b"].all_missing
    out = prep.impute_transform(df, prep.impute_fit(df, ["a", "b"]), ["a", "b"]).collect()
    assert all(r.b == 0.0 for r in out)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "id int, x double")
    m = pf.missing_profile(pf.nan_to_null(df), ["x"]).first()
    assert m.n_missing == 1


def test_capitalize_and_pad(spark):
    df = spark.createDataFrame([("hello WORLD",), ("a",), ("averyveryverylongword",)], "s string")
    rows = df.select(tx.capitalize(F.col("s")).alias("c"), tx.pad_text(F.col("s"), 12).alias("p"),
                     F.initcap("s").alias("i")).collect()
    assert rows[0].c == "Hello world" and rows[0].i == "Hello World"
    assert rows[1].p == "a" + " " * 11
    assert rows[2].p == "averyveryverylongword"


def test_format_fixed_matches_printf(spark):
    vals = [12.25, 12.35, 0.25, 2.675, 1234.5678, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r.t for r in df.select(tx.format_fixed(F.col("v"), 1).alias("t")).collect()]
    assert got == ["%.1f" % v for v in vals]


def test_safe_divide(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (3, 4)], "a int, b int")
    got = [r.q for r in df.select(tx.safe_divide(F.col("a"), F.col("b")).alias("q")).collect()]
    assert got == [0.0, 0.0, 0.75]


def test_split_of_tiny_tables(spark):
    one = spark.createDataFrame([(7,)], "id long")
    assert [r.split for r in sp.train_test_split(one, "id").collect()] == ["test"]   # ceil(0.2) = 1
    five = spark.range(5).withColumnRenamed("id", "id")
    assert sp.train_test_split(five, "id").where("split = 'test'").count() == math.ceil(0.2 * 5)


def test_capped_sample_keeps_small_groups_whole(spark):
    df = spark.createDataFrame([(i, "big" if i < 50 else "small") for i in range(60)], "id long, g string")
    out = sp.capped_sample(df, "id", "g", 20)
    counts = {r.g: r["count"] for r in out.groupBy("g").count().collect()}
    assert counts == {"big": 20, "small": 10}


def test_layout_roundtrip(spark):
    from tessera.operators.fusion import Layout
    lay = Layout([("a", 2), ("b", 3), ("c", None)])
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0, 5.0], [6.0])], "a array<double>, b array<double>, c array<double>")
    fused = df.select(lay.fuse(a=F.col("a"), b=F.col("b"), c=F.col("c")).alias("v"))
    parts = lay.parts_of(F.col("v"))
    row = fused.select(*[parts[n].alias(n) for n in lay.names]).first()
    assert row.a == [1.0, 2.0] and row.b == [3.0, 4.0, 5.0] and row.c == [6.0]


def test_empty_inputs(spark):
    from tessera.operators import balance as bl
    from tessera.operators.ordinal import exact_quantiles, rank_within
    e = spark.createDataFrame([], "id long, vec array<double>, label string, x double")
    assert rank_within(e, ["id"], ["label"]).count() == 0
    assert exact_quantiles(e, ["label"], "x", [0.5]).count() == 0
    assert sp.train_test_split(e, "id").count() == 0
    assert sp.stratified_folds(e, "id", "label").count() == 0
    assert bl.knn_within_class(e, "id", "vec", "label").count() == 0
    assert bl.smote(e, "id", "vec", "label").count() == 0


def test_smote_single_row_class_copies(spark):
    from tessera.operators import balance as bl
    rows = [(i, [float(i), 1.0], "big") for i in range(6)] + [(100, [7.0, 7.0], "one")]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    out = bl.smote(df, "id", "vec", "label", 5)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"big": 6, "one": 6}
    syn = out.where("label = 'one' AND src = 'synth'").collect()
    assert len(syn) == 5 and all(r.vec == [7.0, 7.0] and r.base_id == 100 and r.nbr_id == 100 for r in syn)


def test_folds_reject_k_above_every_class(spark):
    import pytest
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(5)], "id long, label string")
    with pytest.raises(ValueError):
        sp.stratified_folds(df, "id", "label", 5)
    assert sp.stratified_folds(df, "id", "label", 3).count() == 5
