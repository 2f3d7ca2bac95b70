"""Classifier training and scoring with Spark ML.

Feature arrays become ML vectors only at the estimator boundary
(``array_to_vector``).  Training frames are checkpointed into the shared
checkpoint folder first: iterative solvers scan them many times and the
lineage (split, scale, SMOTE) should not be replayed on executor loss.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import metrics as mt
from tessera.operators.forest import Forest, load_model  # noqa: F401
from tessera.operators.joins import broadcast_checked
from tessera.operators.prep import _bounded_collect


def ml_frame(df: DataFrame, vec: str, idx: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>"))).withColumn(
        "label", F.col(idx).cast("double"))


from tessera.session import for_solver, materialize  # noqa: E402,F401


def logistic(n_train: int, max_iter: int = 1000) -> LogisticRegression:
    """Multinomial, L2 with C = 1: sklearn minimises 1/2|w|^2 + C sum(loss),
    Spark (1/n) sum(loss) + lambda/2 |w|^2, so lambda = 1 / (C n)."""
    return LogisticRegression(maxIter=max_iter, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                              standardization=False, family="multinomial", tol=1e-6)


def forest(num_trees: int = 100, max_depth: int = 30, seed: int = 42) -> Forest:
    return Forest(numTrees=num_trees, featureSubsetStrategy="sqrt", maxDepth=max_depth, seed=seed, maxBins=64,
                  maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10)


def boosted(max_iter: int = 100, max_depth: int = 6, step: float = 0.3, seed: int = 42,
            parallelism: int = 4) -> OneVsRest:
    """Multi-class boosted trees: one-vs-rest over Spark's binary GBT."""
    gbt = GBTClassifier(maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed, maxBins=64)
    return OneVsRest(classifier=gbt, parallelism=parallelism)


def mlp(n_features: int, n_classes: int, hidden: int = 64, max_iter: int = 200, seed: int = 42):
    return MultilayerPerceptronClassifier(layers=[n_features, hidden, n_classes], maxIter=max_iter, seed=seed,
                                          blockSize=128)


def predict(model, df: DataFrame) -> DataFrame:
    """Adds integer ``pred_idx`` (and drops ML vector columns)."""
    out = model.transform(df).withColumn("pred_idx", F.col("prediction").cast("int"))
    drop = [c for c in ("rawPrediction", "probability") if c in out.columns]
    return out.drop(*drop)


def decoded(pred: DataFrame, index: DataFrame, true_idx: str = "label") -> DataFrame:
    m = broadcast_checked(index.select(F.col("idx").alias("_pi"), F.col(index.columns[0]).alias("y_pred")))
    t = broadcast_checked(index.select(F.col("idx").alias("_ti"), F.col(index.columns[0]).alias("y_true")))
    p = pred.join(m, pred["pred_idx"] == m["_pi"], "left").drop("_pi")
    return p.join(t, p[true_idx].cast("int") == t["_ti"], "left").drop("_ti")


def evaluate(pred: DataFrame, name: str) -> DataFrame:
    """(model, n, accuracy, macro_precision, macro_recall, macro_f1)."""
    return mt.summary(pred.withColumn("model", F.lit(name)), "y_true", "y_pred", by=["model"])


def feature_importances(model) -> list[float]:
    """Forest/GBT importances; one-vs-rest: mean over the class models."""
    if hasattr(model, "featureImportances"):
        return list(model.featureImportances.toArray())
    if hasattr(model, "models"):
        arrs = [m.featureImportances.toArray() for m in model.models]
        return [float(sum(v) / len(arrs)) for v in zip(*arrs)]
    raise TypeError("model has no feature importances")


def importance_frame(spark, importances: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(importances)], "feature int, importance double")


def top_k(importance: DataFrame, k: int = 10) -> DataFrame:
    """Top-k by importance, descending, index breaks ties."""
    return importance.orderBy(F.desc("importance"), F.asc("feature")).limit(k)


def class_count(index: DataFrame) -> int:
    return len(_bounded_collect(index, 1 << 16))
