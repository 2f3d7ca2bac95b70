"""Metric, report and text queries over the prediction stand-in ``v_pred``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import metrics as mt, prep
from tessera.plans import evaluation as ev
from tessera.plans.catalog.prep_queries import FOLD_CTES, cls_folds
from tessera.plans.catalog.registry import query, r6
from tessera.plans.preprocess import r6 as R6
from tessera.plans.views import Views

PC_CTES = """cm AS (SELECT model, y_true, y_pred, count(*) AS n FROM v_pred_long GROUP BY model, y_true, y_pred),
  roles AS (SELECT model, y_true AS label, n AS s, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, 0 AS p FROM cm
            UNION ALL SELECT model, y_pred AS label, 0 AS s, 0 AS tp, n AS p FROM cm),
  pc0 AS (SELECT model, label, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted,
                 CAST(sum(tp) AS BIGINT) AS tp FROM roles GROUP BY model, label),
  pc AS (SELECT *, predicted - tp AS fp, support - tp AS fn,
                coalesce(CAST(tp AS DOUBLE) / nullif(CAST(predicted AS DOUBLE), 0), 0.0) AS precision,
                coalesce(CAST(tp AS DOUBLE) / nullif(CAST(support AS DOUBLE), 0), 0.0) AS recall,
                coalesce(CAST(2 * tp AS DOUBLE) / nullif(CAST(support + predicted AS DOUBLE), 0), 0.0) AS f1
         FROM pc0),
  summ AS (SELECT model, CAST(sum(support) AS BIGINT) AS n, CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy,
                  avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1
           FROM pc GROUP BY model)"""


def _pl(spark, sf):
    return Views(spark, sf).v_pred_long()


def _summary(spark, sf):
    return mt.summary(_pl(spark, sf), by=["model"])


@query("confusion_matrix", "SELECT model, y_true, y_pred, count(*) AS n FROM v_pred_long GROUP BY model, y_true, y_pred")
def q_confusion_matrix(spark, sf):
    return mt.confusion_matrix(_pl(spark, sf), by=["model"])


for _m in ["accuracy", "macro_precision", "macro_recall", "macro_f1"]:
    def _mk(m):
        def fn(spark, sf):
            return _summary(spark, sf).select("model", R6(F.col(m)).alias(m))
        fn.__name__ = f"q_{m}"
        return fn
    query(_m, f"WITH {PC_CTES} SELECT model, {r6(_m)} AS {_m} FROM summ")(_mk(_m))


@query("classification_report", f"""WITH {PC_CTES}
  SELECT model, label AS row, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1,
         support FROM pc
  UNION ALL SELECT model, 'accuracy', NULL, NULL, {r6('accuracy')}, n FROM summ
  UNION ALL SELECT model, 'macro avg', {r6('macro_precision')}, {r6('macro_recall')}, {r6('macro_f1')}, n FROM summ
  UNION ALL SELECT model, 'weighted avg',
      {r6('coalesce(sum(precision * support) / nullif(sum(support), 0), 0.0)')},
      {r6('coalesce(sum(recall * support) / nullif(sum(support), 0), 0.0)')},
      {r6('coalesce(sum(f1 * support) / nullif(sum(support), 0), 0.0)')},
      CAST(sum(support) AS BIGINT) FROM pc GROUP BY model""")
def q_classification_report(spark, sf):
    r = mt.classification_report(_pl(spark, sf), by=["model"])
    return r.select("model", "row", *[R6(F.col(c)).alias(c) for c in ["precision", "recall", "f1"]], "support")


@query("label_universe", "SELECT model, y_true AS label FROM v_pred_long UNION SELECT model, y_pred FROM v_pred_long")
def q_label_universe(spark, sf):
    return mt.label_universe(_pl(spark, sf), by=["model"])


@query("safe_divide", f"WITH {PC_CTES} SELECT model, label, tp, predicted, {r6('precision')} AS precision FROM pc")
def q_safe_divide(spark, sf):
    pc = mt.per_class(_pl(spark, sf), by=["model"])
    return pc.select("model", "label", "tp", "predicted",
                     R6(tx.safe_divide(F.col("tp"), F.col("predicted"))).alias("precision"))


_IDX = """(SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx
          FROM (SELECT DISTINCT label FROM v_cls) d)"""


@query("cross_entropy", f"""SELECT count(*) AS n, {r6('avg(-ln(greatest(scores[i.idx + 1], 1e-12)))')} AS loss
    FROM v_pred p JOIN {_IDX} i ON p.y_true = i.label""")
def q_cross_entropy(spark, sf):
    v = Views(spark, sf)
    idx = prep.label_index(v.v_cls(), "label")
    p = v.v_pred().join(idx.withColumnRenamed("label", "y_true"), "y_true")
    return mt.cross_entropy(p, "idx", probs="scores").select("n", R6(F.col("loss")).alias("loss"))


@query("cross_entropy_logits", f"""SELECT count(*) AS n, {r6("avg(ln(list_sum(list_transform(scores, lambda s: exp(s * 5)))) - scores[i.idx + 1] * 5)")} AS loss
    FROM v_pred p JOIN {_IDX} i ON p.y_true = i.label""")
def q_cross_entropy_logits(spark, sf):
    """The loss from logits (five times the scores) instead of probabilities."""
    v = Views(spark, sf)
    idx = prep.label_index(v.v_cls(), "label")
    p = prep.label_encode(v.v_pred().withColumnRenamed("y_true", "label"), "label", idx)
    p = p.select("idx", F.transform("scores", lambda s: s * 5).alias("logits"))
    return mt.cross_entropy(p, "idx", logits="logits").select("n", R6(F.col("loss")).alias("loss"))


_METRICS = ["accuracy", "macro_precision", "macro_recall", "macro_f1"]


@query("metric_report", f"WITH {PC_CTES} " + " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, {r6(m)} AS value, printf('%.4f', {m}) AS value_fmt FROM summ" for m in _METRICS))
def q_metric_report(spark, sf):
    s = _summary(spark, sf)
    long = s.unpivot(["model"], _METRICS, "metric", "v")
    return long.select("model", "metric", R6(F.col("v")).alias("value"), tx.format_fixed(F.col("v"), 4).alias("value_fmt"))


@query("best_model", f"""WITH {PC_CTES}
  SELECT model AS best_model, {r6('macro_f1')} AS macro_f1 FROM summ
  ORDER BY macro_f1 DESC, CASE model WHEN 'rule_a' THEN 0 ELSE 1 END LIMIT 1""")
def q_best_model(spark, sf):
    s = _summary(spark, sf).withColumn("pos", F.when(F.col("model") == "rule_a", 0).otherwise(1))
    # first model wins a tie: maximise (f1, -position)
    return s.agg(F.max_by("model", F.struct(F.col("macro_f1"), -F.col("pos"))).alias("best_model"),
                 R6(F.max("macro_f1")).alias("macro_f1"))


@query("fold_summary", f"""WITH {FOLD_CTES},
  fa AS (SELECT fold, avg(CASE WHEN p.y_true = p.y_pred THEN 1.0 ELSE 0.0 END) AS acc
         FROM folds JOIN v_pred p USING (id) GROUP BY fold)
  SELECT count(*) AS n_folds, {r6('avg(acc)')} AS mean_acc, {r6('stddev_pop(acc)')} AS std_acc FROM fa""")
def q_fold_summary(spark, sf):
    f = cls_folds(spark, sf).select("id", "fold")
    p = Views(spark, sf).v_pred()
    fa = f.join(p, "id").groupBy("fold").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    return ev.fold_summary(fa).select("n_folds", R6(F.col("mean_acc")).alias("mean_acc"), R6(F.col("std_acc")).alias("std_acc"))


@query("argmax_class", "SELECT id, CAST(list_position(vec, list_max(vec)) - 1 AS INTEGER) AS argmax FROM v_img")
def q_argmax_class(spark, sf):
    return Views(spark, sf).v_img().select("id", mt.argmax_index(F.col("vec")).alias("argmax"))
