"""Bulk scoring from stored state.

``train`` is the job that leaves state behind: a fitted pipeline and the
tabular medians.  ``score_images`` is another job, which gets paths only: it
loads both, fills the tabular part of every image row with the medians and the
audio part with zeros, and fits nothing."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fusion as fu, prep, profile as pf, stages as st
from tessera.plans.views import CLASSES, TAB_FEATURES as TF, Views
from tessera.session import scratch_path
from tessera.sources import files, sinks

AUDIO_WIDTH, IMAGE_WIDTH = 3, 64
WIDTH = len(TF) + AUDIO_WIDTH + IMAGE_WIDTH
_STATE: dict = {}


def fixed_weight(c: int, j: int) -> float:
    """The stand-in model's weight of class c for feature j."""
    return ((31 * c + 17 * j + 7 * c * j) % 23 - 11) / 10


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(ordinal, id, label, vec): v_tab, three figures of every user's signal, and v_img, lined up by position and fused."""
    v = Views(spark, sf)
    signal = v.t("events").groupBy(F.col("user_id").alias("id")).agg(F.array(F.avg("value"), F.min("value"), F.max("value")).alias("aud"))
    a = fu.align_by_position({"tab": (v.v_tab(), ["id"]), "aud": (signal, ["id"]), "img": (v.v_img(), ["id"])})
    return a.select("ordinal", F.col("tab_id").alias("id"), F.col("tab_label").alias("label"), F.concat(F.array(*[F.col(f"tab_{c}").cast("double") for c in TF]), F.col("aud_aud"), F.col("img_vec").cast("array<double>")).alias("vec"))


def train(spark: SparkSession, sf: str, root: str) -> str:
    """Fit imputer and scaler on the fused training rows and save them with the
    linear model as one pipeline, and the medians of the table, below ``root``."""
    rows = training_rows(spark, sf)
    weights = [fixed_weight(c, j) for c in range(len(CLASSES)) for j in range(WIDTH)]
    pipe = st.TrainingPipeline(stages=[st.ArrayMedianImputer(inputCol="vec"), st.ArrayPopulationScaler(inputCol="vec"),
                                       st.LinearScorer(inputCol="vec", weights=weights, biases=[0.0] * len(CLASSES)),
                                       st.PredictionDecoderModel(inputCol="prediction", outputCol="pred_label", labels=CLASSES)])
    pipe.fit(rows).write().overwrite().save(f"{root}/pipeline")
    medians = pf.column_medians(Views(spark, sf).v_tab(), TF)
    sinks.write_params(sinks.params_long(tabular=medians), f"{root}/params")
    return root


def score_images(spark: SparkSession, state: str, images: str | DataFrame, vec: str = "vec") -> DataFrame:
    """The rows of ``images`` (a path or a frame with the pixel array ``vec``)
    with ``scores``, ``prediction`` and ``pred_label``."""
    rows = spark.read.parquet(images) if isinstance(images, str) else images
    medians = prep.params_dict(files.read_params(spark, f"{state}/params", "tabular"), "key", "value")
    known = F.array(*[F.lit(float(medians[c])) for c in TF], *[F.lit(0.0)] * AUDIO_WIDTH)
    fused = rows.withColumn(vec, F.concat(known, F.col(vec).cast("array<double>")))
    return PipelineModel.load(f"{state}/pipeline").transform(fused)


def state_of(spark: SparkSession, sf: str) -> str:
    """The state of an earlier ``train`` of this application, or of one now."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STATE:
        _STATE[key] = train(spark, sf, scratch_path(spark, "stored-state"))
    return _STATE[key]
