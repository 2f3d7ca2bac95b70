"""Stream scoring of arriving requests.

The micro-batch plan is ``tessera.operators.score.score_requests`` — the
same function the batch path uses — over a file stream, with the fitted
scaler held as a static parameter row.  The Parquet sink plus checkpoint
gives exactly-once output; ``availableNow`` drains what has arrived and
stops, which is how a scheduled job (or a test) runs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.score import score_requests
from tessera.session import scratch_path


def score_stream(spark: SparkSession, in_dir: str, schema, scaler: dict, out_dir: str | None = None,
                 checkpoint: str | None = None, max_files_per_trigger: int | None = None) -> str:
    """Run the scorer over every request file in ``in_dir``; returns the
    output folder (Parquet)."""
    out_dir = out_dir or scratch_path(spark, "scored")
    checkpoint = checkpoint or scratch_path(spark, "scored-ckpt")
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(in_dir)
    q = (score_requests(src, scaler).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start(out_dir))
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out_dir


def read_scored(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(out_dir)
