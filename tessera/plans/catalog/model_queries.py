"""Spark ML training, comparison, cross-validation, importance and scoring
(checked on row counts: fitted models are not SQL)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera.functions import arrays as ar, text as tx
from tessera.operators import score as sc, stages as st, train as tr
from tessera.plans import evaluation as ev, stored_scoring as ss
from tessera.plans.catalog.fusion_queries import aligned_mfcc
from tessera.plans.catalog.registry import query, r6
from tessera.plans.preprocess import r6 as R6
from tessera.plans.views import CLASSES, TAB_FEATURES as TF, Views
from tessera.session import scratch_path
from tessera.sources import sinks
from tessera.sources.media import EMOTIONS

# Boosting rounds / depth used by the registered queries; README has the figures of the operator's defaults (100, 6).
GBT_ROUNDS, GBT_DEPTH = 20, 4


def _cls(spark, sf):
    """Train and test rows of the fused feature table: 5 tabular, 3 signal and 64 image features."""
    return ev.prepare(ss.training_rows(spark, sf), "id", "vec", "label")


def _one(spark, sf, name, **kw):
    p = _cls(spark, sf)
    _, pred = ev.fit_score(name, p, **kw)
    return tr.evaluate(pred, name)


@query("train_logistic")
def q_train_logistic(spark, sf):
    return _one(spark, sf, "logistic")


@query("train_forest")
def q_train_forest(spark, sf):
    return _one(spark, sf, "forest")


@query("train_gbt")
def q_train_gbt(spark, sf):
    return _one(spark, sf, "boosted", max_iter=GBT_ROUNDS, max_depth=GBT_DEPTH)


@query("train_mlp")
def q_train_mlp(spark, sf):
    return _one(spark, sf, "mlp")


@query("compare_models")
def q_compare_models(spark, sf):
    p = _cls(spark, sf)
    return ev.compare_models(p, {"logistic": {}, "forest": {},
                                 "boosted": {"max_iter": GBT_ROUNDS, "max_depth": GBT_DEPTH}})


@query("cross_validate")
def q_cross_validate(spark, sf):
    return ev.cross_validate(ss.training_rows(spark, sf), "id", "vec", "label", 5, "boosted",
                             max_iter=GBT_ROUNDS, max_depth=GBT_DEPTH)


@query("feature_importance")
def q_feature_importance(spark, sf):
    p = _cls(spark, sf)
    model, _ = ev.fit_score("forest", p)
    return tr.importance_frame(spark, tr.feature_importances(model))


@query("topk_importance", f"""SELECT CAST(pos AS INTEGER) AS feature, {r6('imp')} AS importance FROM (
    SELECT u.pos, avg(abs(CAST(vec[u.pos + 1] AS DOUBLE))) AS imp FROM v_img, range(64) u(pos) GROUP BY u.pos)
    ORDER BY imp DESC, pos LIMIT 10""")
def q_topk_importance(spark, sf):
    """Top-10 positions of a per-dimension importance array computed from
    the data (mean absolute embedding value)."""
    v = Views(spark, sf).v_img()
    imp = (v.select(F.posexplode("vec").alias("pos", "x"))
           .groupBy(F.col("pos").cast("int").alias("feature"))
           .agg(F.avg(F.abs(F.col("x").cast("double"))).alias("importance")))
    return tr.top_k(imp, 10).withColumn("importance", R6(F.col("importance")))


@query("load_model")
def q_load_model(spark, sf):
    p = _cls(spark, sf)
    model, _ = ev.fit_score("forest", p)
    path = sinks.save_model(model, scratch_path(spark, "forest-model"))
    loaded = tr.load_model(path)
    return tr.decoded(tr.predict(loaded, p.test), p.index).select("y_true", "y_pred", "pred_idx")


_EMO_SQL = "[" + ", ".join(f"'{e}'" for e in EMOTIONS) + "]"
_STORED_CTES = f"""ta AS (SELECT row_number() OVER (ORDER BY id) AS o, * FROM v_tab),
  au AS (SELECT row_number() OVER (ORDER BY user_id) AS o, [avg(value), min(value), max(value)] AS aud FROM events GROUP BY user_id),
  im AS (SELECT row_number() OVER (ORDER BY id) AS o, vec FROM v_img),
  fused AS (SELECT o, [{", ".join(f"{c}::DOUBLE" for c in TF)}] || aud || vec::DOUBLE[] AS x FROM ta JOIN au USING (o) JOIN im USING (o)),
  cells AS (SELECT o, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS j FROM fused),
  med AS (SELECT j, coalesce(quantile_cont(x, 0.5), 0.0) AS med FROM cells GROUP BY j),
  st AS (SELECT j, avg(coalesce(x, med)) AS mean, coalesce(nullif(stddev_pop(coalesce(x, med)), 0), 1.0) AS scale FROM cells JOIN med USING (j) GROUP BY j),
  tm AS (SELECT [{", ".join(f"quantile_cont({c}::DOUBLE, 0.5)" for c in TF)}, 0.0, 0.0, 0.0] AS known FROM v_tab),
  q AS (SELECT id, label, unnest(known || vec::DOUBLE[]) AS x, generate_subscripts(known || vec::DOUBLE[], 1) - 1 AS j FROM v_img, tm),
  sc AS (SELECT id, label, c, round(sum((x - mean) / scale * (((31 * c + 17 * j + 7 * c * j) % 23 - 11) / 10.0)), 6) + 0.0 AS score
         FROM q JOIN st USING (j), range({len(CLASSES)}) r(c) GROUP BY id, label, c),
  scored AS (SELECT id, {_EMO_SQL}[label % {len(EMOTIONS)} + 1] AS folder, list(score ORDER BY c) AS scores,
               [{", ".join(f"'{c}'" for c in CLASSES)}][list_position(list(score ORDER BY c), max(score))] AS pred_label FROM sc GROUP BY id, label)"""


@query("fused_rows", f"""WITH {_STORED_CTES} SELECT o - 1 AS ordinal, list_transform(x, lambda v: round(v, 6) + 0.0) AS vec FROM fused""")
def q_fused_rows(spark, sf):
    """The fused feature table: tabular fields, figures of the whole signal, image vector."""
    return ss.training_rows(spark, sf).select("ordinal", F.transform("vec", lambda v: R6(v)).alias("vec"))


def _three_branches():
    """A stand-in for a network with a branch per modality: forward(tab, aud, img) -> class scores."""
    rng = np.random.default_rng(11)
    w_tab, w_aud, w_img = (rng.standard_normal((n, len(CLASSES))).astype(np.float32) for n in (len(TF), ss.AUDIO_WIDTH, ss.IMAGE_WIDTH))

    def forward(tab: np.ndarray, aud: np.ndarray, img: np.ndarray) -> np.ndarray:
        return np.tanh(tab @ w_tab) + np.tanh(aud @ w_aud) + np.tanh(img @ w_img)
    return forward


@query("forward_three_parts")
def q_forward_three_parts(spark, sf):
    """A caller's three-branch model over the scaled parts of the fused rows."""
    rows = ss.training_rows(spark, sf)
    state = st.TrainingPipeline(stages=[st.ArrayMedianImputer(inputCol="vec"), st.ArrayPopulationScaler(inputCol="vec")]).fit(rows)
    got = sc.external_model_scores(state.transform(rows), _three_branches, "vec", [len(TF), ss.AUDIO_WIDTH, ss.IMAGE_WIDTH])
    return sc.decode_argmax(got, "scores").select("id", "scores", "pred_label")


def _external_images(spark, sf):
    folder = F.element_at(F.array(*[F.lit(e) for e in EMOTIONS]), F.col("label") % len(EMOTIONS) + 1)
    return Views(spark, sf).v_img().select("id", folder.alias("folder"), "vec")


@query("batch_score", f"WITH {_STORED_CTES} SELECT id, folder, list_transform(scores, lambda v: round(v, 4) + 0.0) AS scores, pred_label FROM scored")
def q_batch_score(spark, sf):
    """All external images scored by a job that loads the stored pipeline and
    medians and fits nothing."""
    got = ss.score_images(spark, ss.state_of(spark, sf), _external_images(spark, sf))
    four = lambda v: F.round(v * 10_000) / 10_000 + F.lit(0.0)  # noqa: E731 - of the product, as the SQL rounds: its halves are not those of the decimal
    return got.select("id", "folder", F.transform("scores", four).alias("scores"), "pred_label")


@query("image_prediction_distribution", f"""WITH {_STORED_CTES},
  n AS (SELECT folder, pred_label, count(*) AS n FROM scored GROUP BY ALL)
  SELECT upper(left(folder, 1)) || substr(folder, 2) AS emotion, sum(n)::BIGINT AS total,
    string_agg(pred_label || ': ' || printf('%.1f', n * 100.0 / t) || '%', ', ' ORDER BY n DESC, pred_label) AS distribution
  FROM (SELECT *, sum(n) OVER (PARTITION BY folder) AS t FROM n) GROUP BY folder""")
def q_image_prediction_distribution(spark, sf):
    """Predicted classes of the scored images by their folder, most frequent first."""
    got = ss.score_images(spark, ss.state_of(spark, sf), _external_images(spark, sf))
    n = got.groupBy("folder", "pred_label").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("total", F.sum("n").over(Window.partitionBy("folder")))
    share = F.concat("pred_label", F.lit(": "), tx.format_percent(F.col("n").cast("double") / F.col("total") * 100, 1))
    items = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("pred_label").alias("l"), share.alias("t"))))
    return (n.groupBy("folder").agg(F.max("total").alias("total"), items.alias("items"))
            .select(tx.capitalize(F.col("folder")).alias("emotion"), "total", F.array_join(F.transform("items", lambda x: x["t"]), ", ").alias("distribution")))


_PROJ_SEED, _EMBED_DIM = 7, 16


def _embedder():
    """Loader for predict_batch_udf: a fixed random projection 64 -> 16 with
    ReLU, standing in for a pluggable image encoder."""
    w = np.random.default_rng(_PROJ_SEED).standard_normal((64, _EMBED_DIM)).astype(np.float32) / 8.0

    def predict(x: np.ndarray) -> np.ndarray:
        return np.maximum(x.reshape(-1, 64) @ w, 0.0)

    return predict


@query("embed_images")
def q_embed_images(spark, sf):
    embed = predict_batch_udf(_embedder, return_type=ArrayType(FloatType()), batch_size=256,
                              input_tensor_shapes=[[64]])
    v = Views(spark, sf).v_img()
    return v.select("id", "label", embed(F.col("vec")).alias("embedding"))


@query("end_to_end_eval")
def q_end_to_end_eval(spark, sf):
    """Fuse image, audio and tabular parts (image -> audio -> tabular order),
    impute, encode, split, scale, SMOTE, boosted trees, macro metrics."""
    a = aligned_mfcc(spark, sf)
    fused = F.concat(ar.to_double(F.col("img_vec")), F.col("sig_mfcc"),
                     F.array(*[F.col(f"tab_{c}").cast("double") for c in TF]))
    df = a.select(F.col("ordinal").alias("id"), fused.alias("vec"), F.col("tab_label").alias("label"))
    p = ev.prepare(df, "id", "vec", "label")
    _, pred = ev.fit_score("boosted", p, max_iter=GBT_ROUNDS, max_depth=GBT_DEPTH)
    return tr.evaluate(pred, "boosted")
