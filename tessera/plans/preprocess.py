"""Preprocessing flow of the reference's feature-table script, as one plan:
encode labels -> hash split -> median impute (train) -> standardise (train)
-> per class x split summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import prep, split as sp
from tessera.session import materialize


def r6(c):
    """Round to 6 decimals and fold -0.0 into 0.0 (for stable comparisons)."""
    return F.round(c, 6) + F.lit(0.0)


def prepared(tab: DataFrame, features, id_col="id", label="label", fit_on="train") -> DataFrame:
    """The scaled, imputed, encoded feature table with its split column."""
    idx = prep.label_index(tab, label)
    s = sp.train_test_split(tab, id_col)
    # two parameter fits read this table: split and encode it once
    s = materialize(prep.label_encode(s, label, idx))
    fit_rows = s.where(F.col("split") == "train") if fit_on == "train" else s
    med = prep.impute_fit(fit_rows, features)
    s = prep.impute_transform(s, med, features)
    fit_rows = s.where(F.col("split") == "train") if fit_on == "train" else s
    sc = prep.scale_fit(fit_rows, features)
    return prep.scale_transform(s, sc, features)


def prep_summary(tab: DataFrame, features, id_col="id", label="label") -> DataFrame:
    z = prepared(tab, features, id_col, label)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [r6(F.avg(c)).alias(f"mean_{c}") for c in features]
    aggs += [r6(F.stddev_pop(c)).alias(f"std_{c}") for c in features]
    return z.groupBy(label, "idx", "split").agg(*aggs)
