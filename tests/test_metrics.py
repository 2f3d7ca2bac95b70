"""Hand-computed metric corners: a class never predicted, a class only predicted."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as mt


@pytest.fixture()
def preds(spark):
    rows = [("a", "a"), ("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("c", "d")]
    return spark.createDataFrame(rows, "y_true string, y_pred string")


def test_macro_metrics(preds):
    s = mt.summary(preds).first()
    # labels a, b, c, d; precision a=1, b=1/3, c=0 (0/0), d=0; recall a=2/3, b=1, c=0, d=0 (0/0)
    assert s.accuracy == pytest.approx(3 / 6)
    assert s.macro_precision == pytest.approx((1 + 1 / 3) / 4)
    assert s.macro_recall == pytest.approx((2 / 3 + 1) / 4)
    f1 = [2 * 2 / (3 + 2), 2 * 1 / (1 + 3), 0.0, 0.0]
    assert s.macro_f1 == pytest.approx(sum(f1) / 4)


def test_report_rows(preds):
    rep = {r.row: r for r in mt.classification_report(preds).collect()}
    assert set(rep) == {"a", "b", "c", "d", "accuracy", "macro avg", "weighted avg"}
    assert rep["d"].support == 0 and rep["d"].recall == 0.0
    assert rep["accuracy"].precision is None and rep["accuracy"].f1 == pytest.approx(0.5)
    assert rep["weighted avg"].support == 6


def test_label_universe(preds):
    assert sorted(r.label for r in mt.label_universe(preds).collect()) == ["a", "b", "c", "d"]


def test_cross_entropy_logits_and_probs(spark):
    import math
    rows = [(0, [2.0, 1.0, 0.1]), (2, [0.5, 0.5, 3.0])]
    df = spark.createDataFrame(rows, "t int, z array<double>")
    exp = 0.0
    for t, z in rows:
        m = max(z)
        lse = math.log(sum(math.exp(v - m) for v in z)) + m
        exp += -(z[t] - lse)
    got = mt.cross_entropy(df, "t", logits="z").first()
    assert got.n == 2 and got.loss == pytest.approx(exp / 2)
    probs = df.select("t", F.transform("z", lambda v: F.exp(v)).alias("e")).select(
        "t", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))
    assert mt.cross_entropy(probs, "t", probs="p").first().loss == pytest.approx(exp / 2)
