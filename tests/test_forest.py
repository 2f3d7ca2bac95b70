"""Forests that do not fit in the driver: the same kind of trees, kept as a table."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import functions as F

from tessera.operators import forest as fo, train as tr
from tessera.plans import evaluation as ev
from tessera.session import materialize, scratch_path
from tessera.sources import sinks


def _rows(spark, n, seed=1, classes=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 8))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 3] > 0.5)
    y = np.where(rng.random(n) < 0.1, rng.integers(0, classes, n), y)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id int, vec array<double>, idx int")
    return materialize(tr.ml_frame(df.repartition(4, "id"), "vec", "idx"))


def _right(model, df):
    return model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


@pytest.mark.parametrize("local_rows", [None, 300])
def test_a_tree_is_the_one_of_spark_ml(spark, local_rows):
    """One tree over all features, grown by one task or split above first, decides as Spark's."""
    df = _rows(spark, 3000)
    want = DecisionTreeClassifier(maxDepth=12, maxBins=64, seed=1).fit(df)
    state = fo.fit_wide(df, "features", "label", 1, 12, 64, lambda width: width, 1, local_rows)
    assert bool(state["top"]) == bool(local_rows)
    got = fo.WideForestModel(state)
    a, b = (m.transform(df).select("id", F.col("prediction").alias(n)) for m, n in ((want, "p"), (got, "q")))
    same = a.join(b, "id").agg(F.avg((F.col("p") == F.col("q")).cast("double")), F.count(F.lit(1))).first()
    assert same[0] > 0.99 and same[1] == 3000
    assert np.abs(got.featureImportances.toArray() - want.featureImportances.toArray()).max() < 0.02


def test_a_forest_too_large_for_the_driver_is_a_table(spark):
    """3,000 rows x 100 trees: no node is held by the driver; it does as well as
    Spark's, and the saved one gives the same rows."""
    df, test = _rows(spark, 3000), _rows(spark, 1000, seed=2)
    model = tr.forest().fit(df)
    assert isinstance(model, fo.WideForestModel)
    fewer = RandomForestClassifier(numTrees=20, featureSubsetStrategy="sqrt", maxDepth=30, seed=42, maxBins=64).fit(df)
    assert _right(model, test) > _right(fewer, test) - 0.02
    assert np.isclose(sum(tr.feature_importances(model)), 1.0)
    assert set(np.argsort(tr.feature_importances(model))[-4:]) == {0, 1, 2, 3}
    assert {"rawPrediction", "probability", "prediction"} <= set(model.transform(test).columns)
    loaded = tr.load_model(sinks.save_model(model, scratch_path(spark, "m")))
    rows = [sorted(map(tuple, tr.predict(m, test).select("id", "pred_idx").collect())) for m in (model, loaded)]
    assert rows[0] == rows[1] and len(rows[0]) == 1000


def test_a_small_forest_is_the_one_of_spark_ml(spark):
    df = _rows(spark, 200)
    model = tr.forest(num_trees=5).fit(df)
    want = RandomForestClassifier(numTrees=5, featureSubsetStrategy="sqrt", maxDepth=30, seed=42, maxBins=64).fit(df)
    assert [t.toDebugString.split("\n", 1)[1] for t in model.trees] == [t.toDebugString.split("\n", 1)[1] for t in want.trees]
    assert isinstance(tr.load_model(sinks.save_model(model, scratch_path(spark, "m"))), RandomForestClassificationModel)


def test_large_nodes_without_a_split(spark):
    """Rows that no feature tells apart stay one leaf, which is not sent to a task; a
    large node at the last level too."""
    same = spark.createDataFrame([(i, [1.0, 2.0], 0 if i % 3 else 1) for i in range(600)], "id int, vec array<double>, idx int")
    df = materialize(tr.ml_frame(same, "vec", "idx"))
    state = fo.fit_wide(df, "features", "label", 3, 5, 64, lambda width: 1, 7, 100)
    assert state["nodes"] == 3
    got = fo.WideForestModel(state).transform(df)
    assert {r["prediction"] for r in got.select("prediction").collect()} == {0.0} and got.count() == 600
    state = fo.fit_wide(_rows(spark, 2000), "features", "label", 2, 1, 64, lambda width: width, 7, 100)
    assert state["nodes"] <= 4 and sum(_right(fo.WideForestModel(state), _rows(spark, 500, s)) for s in (3, 4)) > 0.9


def test_equal_leaves_below_an_upper_split_are_one(spark):
    """A large node split into two leaves of one class is a leaf, as within a task."""
    rows = [(i, [float(i % 2)], 0 if i % 10 or i % 4 else 1) for i in range(1000)]
    df = materialize(tr.ml_frame(spark.createDataFrame(rows, "id int, vec array<double>, idx int"), "vec", "idx"))
    state = fo.fit_wide(df, "features", "label", 1, 5, 64, lambda width: width, 7, 100)
    assert not state["top"] and sum(state["importances"]) == 0
    got = fo.WideForestModel(state).transform(df).select("prediction", F.col("probability").cast("string")).distinct().collect()
    assert [tuple(r) for r in got] == [(0.0, "[0.95,0.05]")]


def test_small_nodes_split_as_by_statistics():
    """Nodes of few rows, sorted by value, get the split that counts by bin give."""
    rng = np.random.default_rng(3)
    for n in (2, 5, 17, 64):
        x, y, w = rng.integers(0, 64, (n, 6)).astype(np.uint8), rng.integers(0, 3, n), rng.integers(1, 4, n).astype(float)
        total, subsets = np.bincount(y, w, 3)[None], np.arange(6)[None]
        a = fo._counted(fo._statistics(x, y, w, np.zeros(n, int), subsets, 64, 3), total)
        pad = min(p for p in fo.PADS if p >= n)
        b = fo._split_small(x, y, w, np.minimum(np.arange(pad), n - 1)[None], np.array([n]), subsets, total)
        assert all(np.allclose(p, q) for p, q in zip(a, b))


def _prepared(spark):
    labels = ["a", "b", "c"]
    index = spark.createDataFrame(list(zip(labels, range(3))), "label string, idx int")
    return ev.Prepared(_rows(spark, 2600), _rows(spark, 400, seed=2), index, 8, 3)


def _no_forest_in_the_driver(monkeypatch):
    def fit(*_):
        raise AssertionError("a forest of this size in the driver")
    monkeypatch.setattr(RandomForestClassifier, "_fit", fit)


def test_models_are_compared_without_a_forest_in_the_driver(spark, monkeypatch):
    _no_forest_in_the_driver(monkeypatch)
    got = {r["model"]: r for r in ev.compare_models(_prepared(spark), {"logistic": {}, "forest": {}}).collect()}
    assert set(got) == {"logistic", "forest"} and {r["n"] for r in got.values()} == {400}
    assert got["forest"]["accuracy"] > got["logistic"]["accuracy"]


def test_importances_without_a_forest_in_the_driver(spark, monkeypatch):
    p = _prepared(spark)
    want = tr.feature_importances(RandomForestClassifier(numTrees=30, featureSubsetStrategy="sqrt", maxDepth=30, seed=42, maxBins=64).fit(p.train))
    _no_forest_in_the_driver(monkeypatch)
    model, _ = ev.fit_score("forest", p)
    got = tr.importance_frame(spark, tr.feature_importances(model)).collect()
    assert [r["feature"] for r in got] == list(range(8))
    assert max(abs(r["importance"] - w) for r, w in zip(got, want)) < 0.08
    assert {r["feature"] for r in sorted(got, key=lambda r: -r["importance"])[:4]} == {0, 1, 2, 3}
