"""Join helpers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 32 << 20
MAX_ROW_BYTES = 4096


def read_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> pa.Table | None:
    """The rows of ``df`` if they are at most ``max_rows`` rows and
    ``max_bytes`` bytes, none of them over MAX_ROW_BYTES.  A row over that
    size comes as a null, so what reaches the driver is bounded."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{n}`").cast("string")), F.lit(0)) if t in ("string", "binary") or t.startswith(("array", "map", "struct"))
             else F.lit(8) for n, t in df.dtypes]
    size = sum(sizes[1:], sizes[0]).cast("long")
    row = F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(df.columns)])
    got = df.limit(max_rows + 1).select(F.when(size <= MAX_ROW_BYTES, row).alias("row"), size.alias("size")).toArrow()
    if got.num_rows > max_rows or got.column("row").null_count or sum(got.column("size").to_pylist()) > max_bytes:
        return None
    rows = got.column("row").combine_chunks()
    return pa.table([rows.field(i) for i in range(len(df.columns))], names=list(df.columns))


def local_frame(df: DataFrame, rows: pa.Table) -> DataFrame:
    """The rows read from ``df`` as a frame of its schema."""
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows else df.sparkSession.createDataFrame([], df.schema)


def broadcast_checked(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` computed once and broadcast, if it has at most ``max_rows`` rows
    and ``max_bytes`` bytes; otherwise ``df`` unchanged, and adaptive execution
    plans the join from measured sizes."""
    rows = read_if_small(df, max_rows, max_bytes)
    return df if rows is None else F.broadcast(local_frame(df, rows))
