"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import scratch_path

LAST = 9223372036854775807


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under spark.checkpoint.dir and read again:
    later stages neither compute it twice nor lose it with an executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def order_key(df: DataFrame, id_col: str) -> Column:
    """Ids as a key that orders them, null last: integers as longs, others as strings."""
    if isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST))
    return F.coalesce(F.concat(F.lit("0"), F.col(f"`{id_col}`").cast("string")), F.lit("1"))


def row_struct(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """All columns of ``df`` (without ``but``) as one, so that no name of theirs clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in but])
