"""Leak-safe preprocessing: median imputer, standard scaler, label encoder.

Fitting is an aggregation whose result is one small row per feature (or per
class); it is collected once (size checked) and applied as literals, the
same fit/transform split as Spark ML models.  ``fit_on`` chooses the rows
the statistics come from (default: training rows only).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import broadcast_checked
from tessera.operators.ordinal import unpivot_numeric, exact_quantile_table

MAX_PARAM_ROWS = 1_000_000


def _bounded_collect(df: DataFrame, limit: int = MAX_PARAM_ROWS):
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"parameter table exceeds {limit} rows")
    return rows


# ---------------------------------------------------------------- imputer
def impute_fit(df: DataFrame, cols, method: str = "exact") -> DataFrame:
    """(feature, median, all_missing): interpolated median per feature
    (``method='approx'``: sketch median, one pass); a feature with no
    values keeps median 0 and is flagged."""
    cols = list(cols)
    long = unpivot_numeric(df, [], cols)
    med = exact_quantile_table(long, ["feature"], "value", [0.5], ["median"], method)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return (names.join(med, "feature", "left")
            .select("feature", F.coalesce("median", F.lit(0.0)).alias("median"),
                    F.col("median").isNull().alias("all_missing")))


def params_dict(params: DataFrame, key: str, value: str) -> dict:
    return {r[key]: r[value] for r in _bounded_collect(params.select(key, value))}


def impute_transform(df: DataFrame, params: DataFrame | dict, cols) -> DataFrame:
    med = params if isinstance(params, dict) else params_dict(params, "feature", "median")
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(med[c]))) for c in cols})


# ----------------------------------------------------------------- scaler
def scale_fit(df: DataFrame, cols) -> DataFrame:
    """(feature, mean, std, scale): population std; zero std -> scale 1."""
    cols = list(cols)
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in cols])
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"),
                                           F.col(f"s_{c}").alias("std")) for c in cols]))
    return (row.select(stacked.alias("p")).select("p.*")
            .withColumn("scale", F.coalesce(F.nullif(F.col("std"), F.lit(0.0)), F.lit(1.0))))


def scale_transform(df: DataFrame, params: DataFrame | dict, cols) -> DataFrame:
    if isinstance(params, dict):
        p = params
    else:
        p = {r["feature"]: (r["mean"], r["scale"]) for r in _bounded_collect(params)}
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(float(p[c][0]))) / F.lit(float(p[c][1]))
                           for c in cols})


# ---------------------------------------------------------- array features
def array_impute_fit(df: DataFrame, vec: str) -> DataFrame:
    """Median per array position: (pos, median)."""
    long = df.select(F.posexplode(vec).alias("pos", "value")).select(
        F.col("pos").cast("int").alias("feature"), F.col("value").cast("double"))
    return exact_quantile_table(long, ["feature"], "value", [0.5], ["median"]).withColumnRenamed("feature", "pos")


def array_scale_fit(df: DataFrame, vec: str) -> DataFrame:
    """Mean, population std and scale per array position: (pos, mean, std, scale);
    missing values are skipped.  Every task sums its own rows by position and
    hands on one row per position."""

    def moments(batches):
        n = mean = m2 = np.zeros(0)
        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten()
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(np.concatenate(([0], _lengths(lists)[:-1]))), _lengths(lists))
            have = flat.is_valid().to_numpy(zero_copy_only=False)
            x, pos = flat.to_numpy(zero_copy_only=False)[have].astype(np.float64), pos[have]
            size = max(len(n), int(pos.max()) + 1 if len(pos) else 0)
            n, mean, m2 = (np.pad(a, (0, size - len(a))) for a in (n, mean, m2))
            k = np.bincount(pos, minlength=size)
            own = np.bincount(pos, x, size) / np.maximum(k, 1)
            spread = np.bincount(pos, (x - own[pos]) ** 2, size)
            both = np.maximum(n + k, 1)
            mean, m2 = mean + (own - mean) * k / both, m2 + spread + (own - mean) ** 2 * n * k / both
            n = n + k
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n.astype(np.int64)), pa.array(mean), pa.array(m2)],
                                         names=["pos", "n", "mean", "m2"])

    parts = df.select(F.col(vec).cast("array<double>").alias("v")).mapInArrow(moments, "pos int, n long, mean double, m2 double").where("n > 0")
    each = parts.groupBy("pos").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
                                    F.collect_list(F.struct("n", "mean", "m2")).alias("parts"))
    m2 = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    std = F.sqrt(m2 / F.col("n"))
    return each.select("pos", "mean", std.alias("std"), F.coalesce(F.nullif(std, F.lit(0.0)), F.lit(1.0)).alias("scale"))


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def array_scale_transform(df: DataFrame, vec: str, params: DataFrame, out: str | None = None) -> DataFrame:
    rows = sorted(_bounded_collect(params), key=lambda r: r["pos"])
    mean = F.array(*[F.lit(float(r["mean"])) for r in rows])
    scale = F.array(*[F.lit(float(r["scale"])) for r in rows])
    z = F.zip_with(F.zip_with(F.col(vec), mean, lambda x, m: x.cast("double") - m), scale, lambda d, s: d / s)
    return df.withColumn(out or vec, z)


def array_impute_transform(df: DataFrame, vec: str, params: DataFrame, out: str | None = None) -> DataFrame:
    rows = sorted(_bounded_collect(params), key=lambda r: r["pos"])
    med = F.array(*[F.lit(float(r["median"])) for r in rows])
    return df.withColumn(out or vec, F.zip_with(F.col(vec), med, lambda x, m: F.coalesce(x.cast("double"), m)))


# ---------------------------------------------------------- label encoder
def label_index(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels in sorted order -> 0..n-1 (label, idx).  The window
    runs over the distinct-label table only (one row per class)."""
    d = df.select(label).where(F.col(label).isNotNull()).distinct()
    return d.select(label, (F.row_number().over(Window.orderBy(label)) - 1).cast("int").alias("idx"))


def label_encode(df: DataFrame, label: str, index: DataFrame, out: str = "idx") -> DataFrame:
    """Attach the class index; an unknown class raises (as the encoder does)."""
    j = df.join(broadcast_checked(index.withColumnRenamed("idx", "_idx")), label, "left")
    return j.withColumn(out, F.when(F.col("_idx").isNull(),
                                    F.raise_error(F.concat(F.lit("unknown label: "), F.col(label).cast("string"))))
                        .otherwise(F.col("_idx"))).drop("_idx")


def label_decode(df: DataFrame, idx_col: str, index: DataFrame, label: str, out: str) -> DataFrame:
    m = broadcast_checked(index.select(F.col("idx").alias("_i"), F.col(label).alias(out)))
    return df.join(m, df[idx_col] == m["_i"], "left").drop("_i")
