"""Request scoring: validate -> fill defaults -> derive -> scale -> model ->
arg-max -> decode.  One DataFrame function serves batch tables and
micro-batches of a stream; bad requests become an error text, never a
failed job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.metrics import argmax_index
from tessera.operators.prep import _bounded_collect
from tessera.plans.views import CLASSES
from tessera.sources import files, sinks

# Request field defaults and accepted ranges (form sliders).
REQUEST_DEFAULTS = {"depression": 15.0, "anxiety": 20.0, "stress": 19.0, "sleep": 5.0}
REQUEST_RANGES = {"depression": (0.0, 50.0), "anxiety": (0.0, 50.0), "stress": (0.0, 50.0), "sleep": (1.0, 10.0)}
# Texts shown to the user.
MISSING_INPUT_MSG = "Error: Please upload both an audio and image sample."
RESULT_PREFIX = "Mental Health Status: "
REQUEST_FEATURES = ["depression", "anxiety", "stress", "sleep", "heart_rate_bpm"]

# Weights and bias of the stand-in linear scorer, one row per
# class in CLASSES order, one column per REQUEST_FEATURES entry.
LINEAR_WEIGHTS = [
    [-1.0, -1.0, -1.0, 1.0, -0.5],
    [-0.3, -0.3, 0.2, 0.3, 0.0],
    [0.4, 0.5, 0.4, -0.3, 0.2],
    [1.0, 0.8, 0.9, -1.0, 0.6],
]
LINEAR_BIAS = [0.2, 0.1, 0.0, -0.2]


def override_defaults(req: DataFrame, defaults: dict = REQUEST_DEFAULTS) -> DataFrame:
    return req.withColumns({c: F.coalesce(F.col(c), F.lit(float(v))) for c, v in defaults.items()})


def derive_heart_rate(req: DataFrame, out: str = "heart_rate_bpm") -> DataFrame:
    return req.withColumn(out, F.lit(70) + F.col("anxiety") * F.lit(0.8))


def _blank(c):
    return F.col(c).isNull() | (F.col(c) == "")


def require_inputs(req: DataFrame, audio: str = "audio_path", image: str = "image_path") -> DataFrame:
    missing = _blank(audio) | _blank(image)
    return req.withColumn("inputs_ok", ~missing).withColumn(
        "input_error", F.when(missing, F.lit(MISSING_INPUT_MSG)))


def range_errors(ranges: dict = REQUEST_RANGES):
    """First violated range as text, NULL when all fields are in range."""
    conds = [F.when(~F.col(c).between(lo, hi), F.lit(f"Inference Error: {c} out of range [{lo:g}, {hi:g}]"))
             for c, (lo, hi) in ranges.items()]
    return F.coalesce(*conds)


def validated(req: DataFrame) -> DataFrame:
    """Adds ``err`` (NULL for a valid request) after defaults and derivation."""
    r = derive_heart_rate(override_defaults(req))
    missing = _blank("audio_path") | _blank("image_path")
    return r.withColumn("err", F.when(missing, F.lit(MISSING_INPUT_MSG)).otherwise(range_errors()))


def fit_request_scaler(valid: DataFrame) -> dict:
    """Mean and population std (zero -> 1) per request feature, one row."""
    row = valid.agg(*[F.avg(c).alias(f"m_{c}") for c in REQUEST_FEATURES],
                    *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"s_{c}")
                      for c in REQUEST_FEATURES])
    r = _bounded_collect(row, 1)[0]
    return {c: (r[f"m_{c}"], r[f"s_{c}"]) for c in REQUEST_FEATURES}


def linear_logits(z_cols) -> F.Column:
    logits = []
    for w, b in zip(LINEAR_WEIGHTS, LINEAR_BIAS):
        terms = [F.lit(w[j]) * z for j, z in enumerate(z_cols)]
        logits.append(reduce(lambda a, t: a + t, terms, F.lit(b)))
    return F.array(*logits)


def score_requests(req: DataFrame, scaler: dict, keep=()) -> DataFrame:
    """(id, result, pred_label, *keep) for every request.  Staged
    projections keep each intermediate (scaled features, logits, class)
    computed once."""
    keep = list(keep)
    v = validated(req)
    z = v.select("id", "err", *keep, *[F.round((F.col(c) - F.lit(float(scaler[c][0]))) / F.lit(float(scaler[c][1])), 9)
                                .alias(f"_z{j}") for j, c in enumerate(REQUEST_FEATURES)])
    lg = z.select("id", "err", *keep, linear_logits([F.col(f"_z{j}") for j in range(len(REQUEST_FEATURES))]).alias("_lg"))
    classes = F.array(*[F.lit(c) for c in CLASSES])
    pr = lg.select("id", "err", *keep, F.when(F.col("err").isNull(),
                                       F.element_at(classes, argmax_index(F.col("_lg")) + 1)).alias("pred_label"))
    return pr.select("id", F.coalesce(F.col("err"), F.concat(F.lit(RESULT_PREFIX), F.col("pred_label"))).alias("result"),
                     "pred_label", *keep)


def save_request_state(history: DataFrame, path: str) -> str:
    """Fit the scaler on past requests (the valid ones) and write it as a
    parameter table."""
    scaler = fit_request_scaler(validated(history).where(F.col("err").isNull()))
    rows = history.sparkSession.createDataFrame([(c, *map(float, scaler[c])) for c in REQUEST_FEATURES],
                                                "feature string, mean double, scale double")
    return sinks.write_params(sinks.params_long(scale=rows), path)


def load_request_state(spark: SparkSession, path: str) -> dict:
    """The scaler that ``save_request_state`` wrote: feature to (mean, scale)."""
    rows = _bounded_collect(files.read_params(spark, path, "scale"), 1000)
    got = {(r["key"], r["name"]): r["value"] for r in rows}
    return {c: (got[(c, "mean")], got[(c, "scale")]) for c in REQUEST_FEATURES}


def score_batch(req: DataFrame, state: str, keep=()) -> DataFrame:
    """Score requests with stored state: one request's answer does not depend
    on the others of its batch."""
    return score_requests(req, load_request_state(req.sparkSession, state), keep)


def external_model_scores(df: DataFrame, make_predict, vec: str, widths, batch_size: int = 256,
                          out: str = "scores") -> DataFrame:
    """Scores from a caller-supplied model over the modality parts of a fused
    vector (e.g. forward(tab, aud, img)).  ``make_predict`` runs once per
    Python worker and returns ``predict(*parts) -> (batch, classes)``; rows
    reach it in Arrow batches of ``batch_size`` (``predict_batch_udf``)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    from tessera.functions.arrays import slice_modalities
    from tessera.session import ship_package

    ship_package(df.sparkSession)
    parts = slice_modalities(F.col(vec).cast("array<float>"), list(widths))
    udf = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size,
                            input_tensor_shapes=[[w] for w in widths])
    return df.withColumn(out, udf(*parts))


def decode_argmax(df: DataFrame, scores: str, classes=CLASSES, out: str = "pred_label") -> DataFrame:
    arr = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out, F.element_at(arr, argmax_index(F.col(scores)) + 1))
