"""Encoding, imputation, scaling, split, folds, caps and category maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.hashing import sql_hash
from tessera.operators import prep, split as sp
from tessera.plans.catalog.profile_queries import PREP_CTES
from tessera.plans.catalog.registry import query, r6
from tessera.plans.preprocess import r6 as R6
from tessera.plans.views import TAB_FEATURES as TF, Views


def _train_tab(spark, sf):
    return sp.train_test_split(Views(spark, sf).v_tab(), "id")


@query("train_test_split", "WITH " + PREP_CTES + " SELECT id, split FROM s")
def q_train_test_split(spark, sf):
    return _train_tab(spark, sf).select("id", "split")


@query("impute_fit", "WITH " + PREP_CTES + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(f'coalesce(quantile_cont(CAST({c} AS DOUBLE), 0.5), 0.0)')} AS median, "
    f"count({c}) = 0 AS all_missing FROM s WHERE split = 'train'" for c in TF))
def q_impute_fit(spark, sf):
    s = _train_tab(spark, sf)
    return prep.impute_fit(s.where("split = 'train'"), TF).withColumn("median", R6(F.col("median")))


def _imputed(spark, sf):
    s = _train_tab(spark, sf)
    med = prep.impute_fit(s.where("split = 'train'"), TF)
    return prep.impute_transform(s, med, TF)


@query("impute_transform", "WITH " + PREP_CTES + " SELECT id, split, "
       + ", ".join(f"{r6(c)} AS {c}" for c in TF) + " FROM imp")
def q_impute_transform(spark, sf):
    return _imputed(spark, sf).select("id", "split", *[R6(F.col(c)).alias(c) for c in TF])


@query("scale_fit", "WITH " + PREP_CTES + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(f'avg({c})')} AS mean, {r6(f'stddev_pop({c})')} AS std, "
    f"{r6(f'coalesce(nullif(stddev_pop({c}), 0), 1.0)')} AS scale FROM imp WHERE split = 'train'" for c in TF))
def q_scale_fit(spark, sf):
    imp = _imputed(spark, sf)
    p = prep.scale_fit(imp.where("split = 'train'"), TF)
    return p.select("feature", *[R6(F.col(c)).alias(c) for c in ["mean", "std", "scale"]])


@query("scale_transform", "WITH " + PREP_CTES + " SELECT id, split, "
       + ", ".join(f"{r6(c)} AS {c}" for c in TF) + " FROM z")
def q_scale_transform(spark, sf):
    imp = _imputed(spark, sf)
    p = prep.scale_fit(imp.where("split = 'train'"), TF)
    z = prep.scale_transform(imp, p, TF)
    return z.select("id", "split", *[R6(F.col(c)).alias(c) for c in TF])


_IDX_CLS = """(SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx
              FROM (SELECT DISTINCT label FROM v_cls) d)"""


@query("label_index", """SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx
                         FROM (SELECT DISTINCT label FROM v_tab) d""")
def q_label_index(spark, sf):
    return prep.label_index(Views(spark, sf).v_tab(), "label")


@query("label_lookup", f"SELECT e.event_type, e.label, i.idx FROM v_emap e LEFT JOIN {_IDX_CLS} i USING (label)")
def q_label_lookup(spark, sf):
    v = Views(spark, sf)
    idx = prep.label_index(v.v_cls(), "label")
    return prep.label_encode(v.v_emap(), "label", idx).select("event_type", "label", "idx")


@query("label_decode", f"""SELECT p.id, p.pred_idx, i.label AS pred_label FROM
    (SELECT id, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS pred_idx FROM v_pred) p
    LEFT JOIN {_IDX_CLS} i ON p.pred_idx = i.idx""")
def q_label_decode(spark, sf):
    v = Views(spark, sf)
    idx = prep.label_index(v.v_cls(), "label")
    p = v.v_pred().select("id", (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("pred_idx"))
    return prep.label_decode(p, "pred_idx", idx, "label", "pred_label")


@query("distinct_counts", "SELECT label, count(*) AS n FROM v_cls GROUP BY label")
def q_distinct_counts(spark, sf):
    return Views(spark, sf).v_cls().groupBy("label").agg(F.count(F.lit(1)).alias("n"))


FOLD_CTES = f"""fr AS (SELECT id, label, vec, row_number() OVER (PARTITION BY label ORDER BY h, id) - 1 AS r
             FROM (SELECT *, {sql_hash('id', "'fold'")} AS h FROM v_cls) c),
  sz AS (SELECT label, count(*) AS n FROM v_cls GROUP BY label),
  off AS (SELECT label, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM sz),
  folds AS (SELECT id, label, vec, CAST((o + r) % 5 AS INTEGER) AS fold FROM fr JOIN off USING (label))"""


def cls_folds(spark, sf, k=5):
    return sp.stratified_folds(Views(spark, sf).v_cls(), "id", "label", k)


@query("stratified_folds", "WITH " + FOLD_CTES + " SELECT id, label, fold FROM folds")
def q_stratified_folds(spark, sf):
    return cls_folds(spark, sf).select("id", "label", "fold")


@query("fold_scale_fit", "WITH " + FOLD_CTES + f"""
  SELECT CAST(i AS INTEGER) AS fold, CAST(p AS INTEGER) AS pos, {r6('avg(vec[p + 1])')} AS mean,
         {r6('stddev_pop(vec[p + 1])')} AS std,
         {r6('coalesce(nullif(stddev_pop(vec[p + 1]), 0), 1.0)')} AS scale
  FROM folds, range(5) t(i), range(4) u(p) WHERE fold <> i GROUP BY i, p""")
def q_fold_scale_fit(spark, sf):
    f = cls_folds(spark, sf)
    k = 5
    ex = f.select(F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i != F.col("fold"))).alias("tf"),
                  F.posexplode("vec").alias("pos", "value"))
    return (ex.groupBy(F.col("tf").cast("int").alias("fold"), F.col("pos").cast("int").alias("pos"))
            .agg(R6(F.avg("value")).alias("mean"), F.stddev_pop("value").alias("_sd"))
            .select("fold", "pos", "mean", R6(F.col("_sd")).alias("std"),
                    R6(F.coalesce(F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(1.0))).alias("scale")))


@query("remap_categories", "SELECT event_id, event_type, label FROM events JOIN v_emap USING (event_type)")
def q_remap_categories(spark, sf):
    v = Views(spark, sf)
    return sp.remap_categories(v.t("events").select("event_id", "event_type"), "event_type", v.v_emap())


@query("balanced_sample", f"""SELECT event_id, label FROM (
    SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY
        {sql_hash('event_id', "'cap|' || label")}, event_id) AS rn
    FROM events JOIN v_emap USING (event_type)) t WHERE rn <= 600""")
def q_balanced_sample(spark, sf):
    v = Views(spark, sf)
    e = sp.remap_categories(v.t("events").select("event_id", "event_type"), "event_type", v.v_emap())
    return sp.capped_sample(e, "event_id", "label", 600).select("event_id", "label")


@query("first_n_per_group", """SELECT event_type, event_id, CAST(rn AS INTEGER) AS rn FROM (
    SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn
    FROM events) t WHERE rn <= 200""")
def q_first_n_per_group(spark, sf):
    e = Views(spark, sf).t("events").select("event_type", "event_id")
    return sp.first_n_per_group(e, "event_type", ["event_id"], 200)
