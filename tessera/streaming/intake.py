"""Arriving requests with media: answered, rejected, or kept waiting.

Every micro-batch joins its requests by path with the features of the media
decoded so far (the store is read anew for each batch), scores what is
complete with a stored pipeline, and writes two tables, ``accepted`` and
``rejected``, one folder per batch.  A valid request whose audio or image is not
there yet waits: it is written to the batch's ``waiting`` folder and joins the
next batches, ``max_wait`` of them, before it is rejected with the path that is
missing.  ``settle`` answers what waits when no more batches come.

A batch reads the requests of its number and the waiting folder of the one
before, and overwrites its own folders, so a batch that runs again after a
failure adds nothing: every request has one answer in one of the two tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.score import REQUEST_FEATURES, RESULT_PREFIX, validated

MEDIA_SCHEMA = "path string, features array<double>, decode_ok boolean"
PARTS = ("audio", "image")
TABLE = "table:"


def with_media(requests: DataFrame, media: DataFrame) -> DataFrame:
    """Validated requests with ``audio`` and ``image`` (features, decode_ok;
    null: not there).  Of several decodings of a path one that went well counts."""
    r = validated(requests)
    for part in PARTS:
        paths = r.where("err is null").select(F.col(f"{part}_path").alias("path")).distinct()
        own = (media.join(paths.hint("shuffle_hash"), "path", "left_semi").groupBy(F.col("path").alias(f"{part}_path"))
               .agg(F.max(F.struct("decode_ok", "features")).alias(part)))
        r = r.join(own, f"{part}_path", "left")
    return r


def complaint() -> F.Column:
    """Why a request with media cannot be scored; null if it can."""
    lost = [F.when(F.col(p).isNull(), F.concat(F.lit(f"Inference Error: no {p} at "), F.col(f"{p}_path"))) for p in PARTS]
    bad = [F.when(~F.col(f"{p}.decode_ok"), F.concat(F.lit("Inference Error: cannot decode "), F.col(f"{p}_path"))) for p in PARTS]
    return F.coalesce(F.col("err"), *lost, *bad)


def fused(joined: DataFrame) -> DataFrame:
    fields = F.array(*[F.col(c).cast("double") for c in REQUEST_FEATURES])
    return joined.withColumn("vec", F.concat(fields, F.col("audio.features"), F.col("image.features")))


def answers(joined: DataFrame, pipeline: PipelineModel) -> DataFrame:
    """(id, pred_label, result) of the requests without a complaint."""
    scored = pipeline.transform(fused(joined))
    return scored.select("id", "pred_label", F.concat(F.lit(RESULT_PREFIX), F.col("pred_label")).alias("result"))


def deliver(rows: DataFrame, table: str, path: str, buckets: int) -> None:
    """Media rows (MEDIA_SCHEMA; features of any number type) added to a table
    bucketed by path, a file per bucket.  Features are far wider than requests:
    they are shuffled here once, as they come, and the batches join them in place."""
    dealt = rows.select("path", "features", "decode_ok").repartition(buckets, "path").withColumn("features", F.col("features").cast("array<double>"))
    dealt.write.mode("append").option("path", path).option("compression", "zstd").bucketBy(buckets, "path").format("parquet").saveAsTable(table)


def read_media(spark: SparkSession, store: str) -> DataFrame:
    """The media there now: ``store`` is a folder of Parquet files, or
    ``table:`` and the name of a table that ``deliver`` fills."""
    if not store.startswith(TABLE):
        return spark.read.schema(MEDIA_SCHEMA).parquet(store)
    spark.catalog.refreshTable(store.removeprefix(TABLE))
    return spark.table(store.removeprefix(TABLE))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def answer_batch(requests: DataFrame, number: int, schema, pipeline: str, media_dir: str, out: str, max_wait: int) -> None:
    """One batch: its requests and those that waited before it."""
    spark = requests.sparkSession
    todo = requests.select(*schema.names, F.lit(number).alias("asked"))
    before = f"{out}/waiting/batch={number - 1}"
    if number > 0 and _exists(spark, before):
        todo = todo.unionByName(spark.read.schema(todo.schema).parquet(before))
    media = read_media(spark, media_dir)
    absent = F.col("err").isNull() & (F.col("audio").isNull() | F.col("image").isNull())
    judged = with_media(todo, media).withColumns({"why": complaint(), "waits": absent & (F.lit(number) - F.col("asked") < max_wait)})
    work = f"{out}/work/batch={number}"
    judged.write.mode("overwrite").option("compression", "zstd").parquet(work)                # computed once for three tables
    judged = spark.read.schema(judged.schema).parquet(work)
    judged.where("waits").select(*todo.columns).write.mode("overwrite").parquet(f"{out}/waiting/batch={number}")
    done = judged.where("not waits")
    answers(done.where("why is null"), PipelineModel.load(pipeline)).write.mode("overwrite").parquet(f"{out}/accepted/batch={number}")
    done.where("why is not null").select("id", F.col("why").alias("reason")).write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")


def answer_stream(spark: SparkSession, in_dir: str, schema, pipeline: str, media_dir: str, out: str, checkpoint: str,
                  max_wait: int = 3, max_files_per_trigger: int | None = None, before_batch: Callable[[int], None] | None = None) -> None:
    """Answer every request file of ``in_dir`` that the checkpoint has not seen."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def each(batch: DataFrame, number: int) -> None:
        if before_batch:
            before_batch(number)
        answer_batch(batch, number, schema, pipeline, media_dir, out, max_wait)

    q = reader.parquet(in_dir).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def settle(spark: SparkSession, schema, pipeline: str, media_dir: str, out: str, last: int) -> None:
    """Answer what waits after batch ``last`` with the media that are there; nothing waits any longer."""
    none = spark.createDataFrame([], schema)
    answer_batch(none, last + 1, schema, pipeline, media_dir, out, max_wait=0)


def read_answers(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected)."""
    return spark.read.parquet(f"{out}/accepted").drop("batch"), spark.read.parquet(f"{out}/rejected").drop("batch")
