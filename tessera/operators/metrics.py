"""Evaluation metrics as relational aggregates over (y_true, y_pred).

Everything is derived from the confusion counts, one small row per
(group, true, predicted) cell, so the full prediction table is scanned
once and the rest works on a table of size groups x classes^2.
Macro averages run over the union of true and predicted labels; 0/0 is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import safe_divide


def confusion_matrix(df: DataFrame, true: str = "y_true", pred: str = "y_pred", by=()) -> DataFrame:
    return df.groupBy(*by, true, pred).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, true: str = "y_true", pred: str = "y_pred", by=()) -> DataFrame:
    """(by.., label, support, predicted, tp, fp, fn, precision, recall, f1)."""
    cm = confusion_matrix(df, true, pred, by)
    hit = F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(F.lit(0))
    roles = F.explode(F.array(
        F.struct(F.col(true).alias("label"), F.col("n").alias("s"), hit.alias("tp"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("tp"),
                 F.col("n").alias("p"))))
    pc = (cm.select(*by, roles.alias("r")).select(*by, "r.*")
          .groupBy(*by, "label")
          .agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp")))
    return (pc.withColumn("fp", F.col("predicted") - F.col("tp"))
              .withColumn("fn", F.col("support") - F.col("tp"))
              .withColumn("precision", safe_divide(F.col("tp"), F.col("predicted")))
              .withColumn("recall", safe_divide(F.col("tp"), F.col("support")))
              .withColumn("f1", safe_divide(2 * F.col("tp"), F.col("support") + F.col("predicted"))))


def summary(df: DataFrame, true: str = "y_true", pred: str = "y_pred", by=()) -> DataFrame:
    """One row per group: n, accuracy, macro precision / recall / F1."""
    pc = per_class(df, true, pred, by)
    return pc.groupBy(*by).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"))


def classification_report(df: DataFrame, true: str = "y_true", pred: str = "y_pred", by=()) -> DataFrame:
    """Per-class rows plus 'accuracy', 'macro avg' and 'weighted avg' rows
    (row, precision, recall, f1, support); the accuracy row carries the
    accuracy in ``f1`` and NULL precision/recall, as the text report."""
    pc = per_class(df, true, pred, by)
    rows = pc.select(*by, F.col("label").alias("row"), "precision", "recall", "f1",
                     F.col("support").cast("long").alias("support"))
    tot = pc.groupBy(*by).agg(
        F.sum("support").alias("_n"), F.sum("tp").alias("_tp"),
        F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"),
        safe_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("_wp"),
        safe_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("_wr"),
        safe_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("_wf"))
    nul = F.lit(None).cast("double")
    extra = tot.select(*by, F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row"), nul.alias("precision"), nul.alias("recall"),
                 safe_divide(F.col("_tp"), F.col("_n")).alias("f1"), F.col("_n").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), F.col("_mp").alias("precision"), F.col("_mr").alias("recall"),
                 F.col("_mf").alias("f1"), F.col("_n").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), F.col("_wp").alias("precision"), F.col("_wr").alias("recall"),
                 F.col("_wf").alias("f1"), F.col("_n").cast("long").alias("support")))).alias("x")
    ).select(*by, "x.*")
    return rows.unionByName(extra)


def label_universe(df: DataFrame, true: str = "y_true", pred: str = "y_pred", by=()) -> DataFrame:
    return (df.select(*by, F.col(true).alias("label"))
            .union(df.select(*by, F.col(pred).alias("label"))).distinct())


def argmax_index(arr) -> F.Column:
    """0-based position of the first maximum (ties: first index)."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def log_softmax(logits) -> F.Column:
    """Numerically stable log-softmax of an array column (max-shifted)."""
    m = F.array_max(logits)
    lse = F.log(F.aggregate(F.transform(logits, lambda z: F.exp(z - m)), F.lit(0.0), lambda a, b: a + b)) + m
    return F.transform(logits, lambda z: z - lse)


def cross_entropy(df: DataFrame, target_idx: str, probs: str | None = None, logits: str | None = None,
                  eps: float = 1e-12, by=()) -> DataFrame:
    """Mean cross-entropy -log p(target), from probabilities (floored at
    ``eps``) or from logits (log-softmax): (by.., n, loss)."""
    if logits is not None:
        lp = F.element_at(log_softmax(F.col(logits)), F.col(target_idx) + 1)
    else:
        lp = F.ln(F.greatest(F.element_at(F.col(probs), F.col(target_idx) + 1), F.lit(eps)))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(-lp).alias("loss"))
