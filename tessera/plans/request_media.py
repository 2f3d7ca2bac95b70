"""Requests with media over the fixture tables: the media store, stored state, and the streamed run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_key
from tessera.operators import stages as st
from tessera.operators.score import REQUEST_FEATURES
from tessera.plans.stored_scoring import AUDIO_WIDTH, IMAGE_WIDTH, fixed_weight
from tessera.plans.views import CLASSES, Views
from tessera.session import num_partitions, scratch_path
from tessera.streaming import intake

LOST, LATE, BROKEN = 23, 29, 31        # of so many media one is never there, late, cannot be decoded
WIDTH = len(REQUEST_FEATURES) + AUDIO_WIDTH + IMAGE_WIDTH
_DONE: dict = {}


def media_parts(spark: SparkSession, sf: str) -> list[DataFrame]:
    """(path, features, decode_ok, late) of audio and of images: three figures of
    the user's signal for every event's audio, an embedding for its image."""
    v = Views(spark, sf)
    events = v.t("events").select("event_id", "user_id", "value")
    per_user = events.groupBy("user_id").agg(F.array(F.avg("value"), F.min("value"), F.max("value")).alias("features"))
    audio = (events.join(per_user, "user_id").where(F.col("event_id") % LOST != 0)
             .select(F.concat(F.lit("a/"), F.col("event_id").cast("string")).alias("path"), "features", F.lit(True).alias("decode_ok"), F.lit(False).alias("late")))
    n = v.t("embeddings").count()
    image = (events.select("event_id", (F.col("event_id") % n).alias("vec_id")).join(v.t("embeddings"), "vec_id")
             .select(F.concat(F.lit("i/"), F.col("event_id").cast("string")).alias("path"), F.col("embedding").alias("features"),
                     (F.col("event_id") % BROKEN != 0).alias("decode_ok"), (F.col("event_id") % LATE == 0).alias("late")))
    return [audio, image]


def train(spark: SparkSession, sf: str, media: DataFrame, path: str) -> str:
    """Scaler of the complete requests that count as history, the linear model and the classes, saved as one pipeline."""
    history = Views(spark, sf).v_req().where(hash_key(F.col("id"), "history") % 2 == 0)
    rows = intake.fused(intake.with_media(history, media).where(intake.complaint().isNull()))
    weights = [fixed_weight(c, j) for c in range(len(CLASSES)) for j in range(WIDTH)]
    pipe = st.TrainingPipeline(stages=[st.ArrayPopulationScaler(inputCol="vec"), st.LinearScorer(inputCol="vec", weights=weights, biases=[0.0] * len(CLASSES)),
                                       st.PredictionDecoderModel(inputCol="prediction", outputCol="pred_label", labels=CLASSES)])
    pipe.fit(rows).write().overwrite().save(path)
    return path


def streamed(spark: SparkSession, sf: str) -> str:
    """All requests through the stream in four batches, the late media arriving
    between the second and the third; returns the folder of the answers."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _DONE:
        return _DONE[key]
    root = scratch_path(spark, "intake")
    requests = Views(spark, sf).v_req()
    name, buckets = f"tessera_media_{uuid.uuid4().hex[:12]}", num_partitions(spark)
    for part in media_parts(spark, sf):
        intake.deliver(part.where("not late"), name, f"{root}/media", buckets)
        intake.deliver(part.where("late"), f"{name}_late", f"{root}/late", buckets)
    media = spark.table(name).unionByName(spark.table(f"{name}_late"))
    pipeline = train(spark, sf, media, f"{root}/pipeline")
    requests.repartition(4, "id").write.parquet(f"{root}/requests")

    def arrive(number: int) -> None:
        if number == 2:
            intake.deliver(spark.table(f"{name}_late"), name, f"{root}/media", buckets)

    store = f"{intake.TABLE}{name}"
    intake.answer_stream(spark, f"{root}/requests", requests.schema, pipeline, store, f"{root}/answers", f"{root}/checkpoint",
                         max_wait=2, max_files_per_trigger=1, before_batch=arrive)
    intake.settle(spark, requests.schema, pipeline, store, f"{root}/answers", last=3)
    for table in (name, f"{name}_late"):
        spark.sql(f"DROP TABLE {table}")                       # the files stay in the scratch folder
    _DONE[key] = f"{root}/answers"
    return _DONE[key]
