"""Profiling of a labelled table: missing values, correlation, class counts,
box-plot statistics and medians (the data behind the reference's figures)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessera.operators.joins import broadcast_checked
from tessera.operators.ordinal import exact_quantile_table, unpivot_numeric


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL on every float/double column, so later operators see NULL only."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def select_numeric(df: DataFrame, exclude=()) -> DataFrame:
    return df.select(*numeric_columns(df, exclude))


def drop_target(df: DataFrame, target: str) -> DataFrame:
    return df.drop(target)


def missing_profile(df: DataFrame, cols=None) -> DataFrame:
    """(column, n_missing, n_rows) in a single aggregation pass."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return (row.unpivot(["_n"], cols, "column", "n_missing")
            .select("column", F.col("n_missing").cast("bigint"), F.col("_n").alias("n_rows")))


def missing_flags(df: DataFrame, id_col: str, cols) -> DataFrame:
    """Per-row null flags (the heat-map matrix) plus a per-row total."""
    flags = [F.col(c).isNull().cast("int").alias(f"miss_{c}") for c in cols]
    total = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.select(id_col, *flags, total.alias("n_missing"))


TILE = 64            # columns of a tile
FAN_IN = 256         # tiles merged by one task of the first level
_STATS = ("n", "sa", "sb", "saa", "sbb", "sab")


def gram_tiles(df: DataFrame, cols, shift=None) -> DataFrame:
    """(bi, bj, tile): for every pair of column blocks bi <= bj, of TILE columns,
    one binary of six matrices (counts, both sums, both sums of squares, sums
    of products over the rows that have both columns), summed over all rows.

    Every task adds up its own rows by matrix products and hands on one packed
    tile per pair of blocks; tiles are merged FAN_IN at a time and then once
    more, so a task of the last level holds one of every FAN_IN tasks' tiles
    (256 for 65,536 tasks, 50 MB)."""
    cols = list(cols)
    low = np.zeros(len(cols)) if shift is None else np.asarray(shift, dtype=np.float64)
    blocks = [(a, min(a + TILE, len(cols))) for a in range(0, len(cols), TILE)]

    def own(batches):
        total: dict = {}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]) - low
            has = ~np.isnan(x)
            m, x = has.astype(np.float64), np.where(has, x, 0.0)
            xx = x * x
            for i, (a, b) in enumerate(blocks):
                for j, (c, d) in enumerate(blocks[i:], i):
                    part = np.stack([m[:, a:b].T @ m[:, c:d], x[:, a:b].T @ m[:, c:d], m[:, a:b].T @ x[:, c:d],
                                     xx[:, a:b].T @ m[:, c:d], m[:, a:b].T @ xx[:, c:d], x[:, a:b].T @ x[:, c:d]])
                    total[i, j] = total[i, j] + part if (i, j) in total else part
        part = TaskContext.get().partitionId()
        for (i, j), tile in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part], pa.int64()),
                                              pa.array([tile.tobytes()], pa.binary())], names=["bi", "bj", "part", "tile"])

    def merged(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(t.as_buffer()) for t in table.column("tile"))
        return table.slice(0, 1).set_column(3, "tile", pa.array([total.tobytes()], pa.binary()))

    wide = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    kind = "bi int, bj int, part long, tile binary"
    tiles = wide.mapInArrow(own, kind).withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
    tiles = tiles.groupBy("bi", "bj", "part").applyInArrow(merged, kind).groupBy("bi", "bj").applyInArrow(merged, kind)
    return tiles.select("bi", "bj", "tile")


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """Pairwise-complete Pearson correlation, long form (col_a, col_b, corr),
    both (a, b) and (b, a); NULL where a column is constant over the rows
    that have both.

    One way at every width: ``gram_tiles``.  Columns are shifted by their
    minimum first, so a constant column is exactly zero.
    """
    cols = list(cols)
    lows = df.agg(*[F.min(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    low = [0.0 if v is None or math.isnan(v) else v for v in lows]
    width = len(cols)

    def pairs(batches):
        for batch in batches:
            for bi, bj, raw in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "tile"))):
                a, c = bi * TILE, bj * TILE
                tile = np.frombuffer(raw).reshape(6, min(TILE, width - a), min(TILE, width - c))
                for i, j, t in [(a, c, tile)] + ([(c, a, tile[[0, 2, 1, 4, 3, 5]].transpose(0, 2, 1))] if bi != bj else []):
                    at = np.indices(t.shape[1:]).reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(at[0] + i), pa.array(at[1] + j), *[pa.array(np.ascontiguousarray(x).ravel()) for x in t]],
                                                     names=["i", "j", *_STATS])

    s = gram_tiles(df, cols, low).mapInArrow(pairs, "i long, j long, " + ", ".join(f"{n} double" for n in _STATS))

    def spread(total: str, squares: str):
        v = F.col(squares) - F.try_divide(F.col(total) * F.col(total), F.col("n"))
        return F.when(v > F.lit(1e-13) * F.col(squares), v)           # less is rounding: constant over these rows

    cov = F.col("sab") - F.try_divide(F.col("sa") * F.col("sb"), F.col("n"))
    r = cov / (F.sqrt(spread("sa", "saa")) * F.sqrt(spread("sb", "sbb")))
    name = F.array(*[F.lit(c) for c in cols])
    pair = s.select(F.element_at(name, (F.col("i") + 1).cast("int")).alias("col_a"),
                    F.element_at(name, (F.col("j") + 1).cast("int")).alias("col_b"),
                    r.alias("r"))
    return pair.select("col_a", "col_b", F.when(F.col("r").isNotNull(), F.greatest(F.least("r", F.lit(1.0)), F.lit(-1.0))).alias("corr"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _long(df: DataFrame, features, label: str, id_col: str | None) -> DataFrame:
    ids = [c for c in (id_col, label) if c]
    return unpivot_numeric(df, ids, features).where(F.col("value").isNotNull())


def _fences(long: DataFrame, label: str, method: str = "exact") -> DataFrame:
    q = exact_quantile_table(long, ["feature", label], "value", [0.25, 0.5, 0.75],
                             ["q1", "median", "q3"], method)
    return (q.withColumn("iqr", F.col("q3") - F.col("q1"))
             .withColumn("_lof", F.col("q1") - 1.5 * F.col("iqr"))
             .withColumn("_hif", F.col("q3") + 1.5 * F.col("iqr")))


def boxplot_stats(df: DataFrame, features, label: str, method: str = "exact") -> DataFrame:
    """Per feature x class: quartiles, 1.5 IQR whiskers at the last datum
    inside the fences (never inside the box), outlier count.

    A point is an outlier exactly when it lies outside the fences, so the
    whiskers and the outlier count come from one pass over the data joined
    with the (features x classes)-row quartile table.
    """
    long = _long(df, features, label, None)
    q = _fences(long, label, method)
    v = F.col("value")
    j = long.join(broadcast_checked(q), ["feature", label])
    return j.groupBy("feature", label, "q1", "median", "q3", "iqr").agg(
        F.count(F.lit(1)).alias("n"),
        F.least(F.coalesce(F.min(F.when(v >= F.col("_lof"), v)), F.first("q1")),
                F.first("q1")).alias("whisker_lo"),
        F.greatest(F.coalesce(F.max(F.when(v <= F.col("_hif"), v)), F.first("q3")),
                   F.first("q3")).alias("whisker_hi"),
        F.sum(((v < F.col("_lof")) | (v > F.col("_hif"))).cast("long")).alias("n_outliers"))


def boxplot_outliers(df: DataFrame, features, label: str, id_col: str) -> DataFrame:
    """The individual points drawn beyond the whiskers."""
    long = _long(df, features, label, id_col)
    q = _fences(long.drop(id_col), label)
    v = F.col("value")
    return (long.join(broadcast_checked(q), ["feature", label])
            .where((v < F.col("_lof")) | (v > F.col("_hif")))
            .select("feature", label, id_col, "value"))


def column_medians(df: DataFrame, cols, method: str = "exact") -> DataFrame:
    """Interpolated median per column, NULL/NaN skipped: (feature, median).
    ``method='approx'`` uses one sketch aggregation instead of a sort."""
    long = unpivot_numeric(df, [], cols)
    return exact_quantile_table(long, ["feature"], "value", [0.5], ["median"], method)
