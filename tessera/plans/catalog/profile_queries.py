"""Profiling queries over the clinical stand-in ``v_tab``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile as pf
from tessera.plans.catalog.registry import query, r6
from tessera.plans.preprocess import prep_summary, r6 as R6
from tessera.plans.views import TAB_FEATURES as TF, Views

ALLC = ["id"] + TF + ["label"]


def _unpivot_sql(cols, ids=("label",), src="v_tab"):
    idl = ", ".join(ids)
    sep = ", " if idl else ""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature{sep}{idl}, CAST({c} AS DOUBLE) AS value FROM {src} WHERE {c} IS NOT NULL"
        for c in cols)


# --------------------------------------------------------------------- entry
_split_sql = """(SELECT t.*, CASE WHEN row_number() OVER (ORDER BY h, id) - 1
                   < ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
                 FROM (SELECT *, ('0x' || substr(md5(CAST(id AS VARCHAR) || ':42:split'), 1, 8))::BIGINT AS h
                       FROM v_tab) t)"""


def _prep_sql():
    med = ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0.0) AS m_{c}" for c in TF)
    imp = ", ".join(f"coalesce(CAST(s.{c} AS DOUBLE), m_{c}) AS {c}" for c in TF)
    sc = ", ".join(f"avg({c}) AS mu_{c}, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS sd_{c}" for c in TF)
    z = ", ".join(f"({c} - mu_{c}) / sd_{c} AS {c}" for c in TF)
    return f"""
      s AS {_split_sql},
      med AS (SELECT {med} FROM s WHERE split = 'train'),
      imp AS (SELECT s.id, s.label, s.split, {imp} FROM s, med),
      sc AS (SELECT {sc} FROM imp WHERE split = 'train'),
      z AS (SELECT imp.id, imp.label, imp.split, {z} FROM imp, sc),
      idx AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx
              FROM (SELECT DISTINCT label FROM v_tab) d)"""


PREP_CTES = _prep_sql()

_summary_sql = (
    "WITH " + PREP_CTES + "\nSELECT z.label, idx.idx, z.split, count(*) AS n, "
    + ", ".join(f"{r6(f'avg({c})')} AS mean_{c}" for c in TF) + ", "
    + ", ".join(f"{r6(f'stddev_pop({c})')} AS std_{c}" for c in TF)
    + " FROM z JOIN idx USING (label) GROUP BY z.label, idx.idx, z.split")


@query("prep_summary", _summary_sql)
def q_prep_summary(spark, sf):
    return prep_summary(Views(spark, sf).v_tab(), TF)


# ------------------------------------------------------------------- profile
@query("missing_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, "
    f"count(*) AS n_rows FROM v_tab" for c in ALLC))
def q_missing_profile(spark, sf):
    return pf.missing_profile(Views(spark, sf).v_tab(), ALLC)


@query("missing_flags", "SELECT id, " + ", ".join(
    f"CAST({c} IS NULL AS INTEGER) AS miss_{c}" for c in TF) + ", "
    + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in TF) + " AS n_missing FROM v_tab")
def q_missing_flags(spark, sf):
    return pf.missing_flags(Views(spark, sf).v_tab(), "id", TF)


def _corr_sql():
    parts = []
    for i, a in enumerate(TF):
        for j, b in enumerate(TF):
            x = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
            y = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                         f"{r6(f'covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)')} AS corr "
                         f"FROM v_tab")
    return " UNION ALL ".join(parts)


@query("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark, sf):
    return pf.correlation_matrix(Views(spark, sf).v_tab(), TF).withColumn("corr", R6(F.col("corr")))


@query("class_distribution", "SELECT label, count(*) AS n FROM v_tab GROUP BY label")
def q_class_distribution(spark, sf):
    return pf.class_distribution(Views(spark, sf).v_tab(), "label")


_box_ctes = f"""WITH long AS ({_unpivot_sql(TF, ("label", "id"))}),
  q AS (SELECT feature, label, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
               quantile_cont(value, 0.75) AS q3 FROM long GROUP BY feature, label),
  f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lof, q3 + 1.5 * (q3 - q1) AS hif FROM q)"""


@query("boxplot_stats", _box_ctes + f"""
  SELECT f.feature, f.label, {r6('q1')} AS q1, {r6('med')} AS median, {r6('q3')} AS q3, {r6('iqr')} AS iqr,
         count(*) AS n,
         {r6('least(coalesce(min(CASE WHEN value >= lof THEN value END), q1), q1)')} AS whisker_lo,
         {r6('greatest(coalesce(max(CASE WHEN value <= hif THEN value END), q3), q3)')} AS whisker_hi,
         CAST(sum(CASE WHEN value < lof OR value > hif THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers
  FROM long JOIN f USING (feature, label)
  GROUP BY f.feature, f.label, q1, med, q3, iqr""")
def q_boxplot_stats(spark, sf):
    b = pf.boxplot_stats(Views(spark, sf).v_tab(), TF, "label")
    return b.select("feature", "label", "n", "n_outliers",
                    *[R6(F.col(c)).alias(c) for c in ["q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi"]])


@query("boxplot_outliers", _box_ctes + """
  SELECT feature, label, id, value FROM long JOIN f USING (feature, label)
  WHERE value < lof OR value > hif""")
def q_boxplot_outliers(spark, sf):
    return pf.boxplot_outliers(Views(spark, sf).v_tab(), TF, "label", "id")


@query("column_medians", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS median FROM v_tab" for c in TF))
def q_column_medians(spark, sf):
    return pf.column_medians(Views(spark, sf).v_tab(), TF).withColumn("median", R6(F.col("median")))


@query("select_numeric", "SELECT id, " + ", ".join(TF) + " FROM v_tab")
def q_select_numeric(spark, sf):
    return pf.select_numeric(Views(spark, sf).v_tab())


@query("drop_target", "SELECT id, " + ", ".join(TF) + " FROM v_tab")
def q_drop_target(spark, sf):
    return pf.drop_target(Views(spark, sf).v_tab(), "label")
