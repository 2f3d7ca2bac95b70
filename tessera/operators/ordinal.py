"""Distributed positions and exact quantiles without a single-task window.

``rank_within`` numbers rows 0..n-1 inside each group in a total order:
range-partition on (group, order) keys, sort inside each partition, take
the partition-local row number from ``monotonically_increasing_id`` and add
the per-(partition, group) offset computed from a small count table.  A hot
group is split across many range partitions, so no task ever holds a whole
group, and the only global step is a window over (#partitions + #groups)
count rows.  The range-shuffle is planned once and reused by both branches
(exchange reuse), so the local numbering is consistent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import local_frame, read_if_small
from tessera.session import materialize, num_partitions

_LOW33 = (1 << 33) - 1


def _as_cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _null_safe_eq(left: DataFrame, right: DataFrame, names: list[str]) -> Column | None:
    conds = [left[n].eqNullSafe(right[n]) for n in names]
    return reduce(lambda a, b: a & b, conds) if conds else None


def rank_within(df: DataFrame, order_cols, group_cols=(), rank_col: str = "_rank",
                size_col: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` (0-based position in ``order_cols`` order within
    ``group_cols``).  ``order_cols`` should make the order total (end with a
    unique key) for a reproducible numbering; for quantiles ties do not
    matter.  ``size_col`` optionally adds the group size.

    The range-partitioned, locally sorted table is checkpointed once: the
    per-partition counts and the final numbering must see the very same
    partitions, and a second range shuffle of an input whose row order is
    not fixed (any shuffle output) could draw different range bounds.
    """
    group_cols = list(group_cols)
    n = partitions or num_partitions(df.sparkSession)
    keys = _as_cols(group_cols) + _as_cols(order_cols)
    s = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .withColumn("_mid", F.monotonically_increasing_id()))
    s = materialize(s)
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_loc", F.col("_mid").bitwiseAND(F.lit(_LOW33)))
    stats = s.groupBy("_pid", *group_cols).agg(F.min("_loc").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*group_cols).orderBy("_pid")
    stats = stats.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if size_col:
        stats = stats.withColumn(size_col, F.sum("_cnt").over(Window.partitionBy(*group_cols)))
    extra = [size_col] if size_col else []
    st = stats.select(*[F.col(g).alias(f"_g_{i}") for i, g in enumerate(group_cols)],
                      F.col("_pid").alias("_spid"), "_first", "_off", *extra)
    cond = s["_pid"] == st["_spid"]
    for i, g in enumerate(group_cols):
        cond = cond & s[g].eqNullSafe(st[f"_g_{i}"])
    # the count table has at most (#partitions + #groups) rows; AQE
    # broadcasts it when its measured size is small
    out = s.join(st, cond, "inner")
    out = out.withColumn(rank_col, F.col("_off") + F.col("_loc") - F.col("_first"))
    drop = ["_mid", "_pid", "_loc", "_spid", "_first", "_off"] + [f"_g_{i}" for i in range(len(group_cols))]
    return out.drop(*drop)


def running_before(df: DataFrame, order_cols, value_col: str, out: str, aggregate=F.max, merge=F.greatest) -> DataFrame:
    """``out``: the aggregate of ``value_col`` over all rows before each row in
    ``order_cols`` order (a total order; null for the first row, missing values
    skipped).

    A prefix scan for any aggregate that merges (maximum and ``greatest`` by
    default): rows are range-partitioned and sorted, every partition's aggregate
    is taken, the aggregates of the partitions before it (a row per partition)
    are merged into its offset, and a window inside each partition adds the
    rows before it there.  The partitioned rows are checkpointed, so offsets and
    windows see the same partitions.
    """
    keys = _as_cols(order_cols)
    rows = materialize(df.repartitionByRange(num_partitions(df.sparkSession), *keys).withColumn("_pid", F.spark_partition_id()))
    each = rows.groupBy("_pid").agg(aggregate(value_col).alias("_of"))
    kind = each.schema["_of"].dataType.simpleString()
    totals = sorted(each.collect(), key=lambda r: r["_pid"])                # a row per partition
    parts = F.array(*[F.struct(F.lit(r["_pid"]).alias("pid"), F.lit(r["_of"]).cast(kind).alias("of")) for r in totals])
    # offsets of the partitions: merged on one small row, then joined back
    offsets = (df.sparkSession.range(1).select(F.explode(parts).alias("x")).select(F.col("x.pid").alias("_p"), F.transform(
        F.filter(parts, lambda y: y["pid"] < F.col("x.pid")), lambda y: y["of"]).alias("_before")) if totals else
        df.sparkSession.createDataFrame([], f"_p int, _before array<{kind}>"))
    offsets = offsets.select("_p", F.aggregate("_before", F.lit(None).cast(kind), lambda s, x: merge(s, x)).alias("_offset"))
    w = Window.partitionBy("_pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(F.broadcast(offsets), F.col("_pid") == F.col("_p"))
    return joined.withColumn(out, merge(aggregate(value_col).over(w), F.col("_offset"))).drop("_pid", "_p", "_offset")


def _coarse(v: Column) -> Column:
    """A bin that never decreases with ``v``: sign and 32nds of the binary
    logarithm, so the values of a bin lie within 2 % of each other."""
    size = F.when(F.abs(v) == float("inf"), F.lit(90_000).cast("long")).otherwise(F.floor(F.log2(F.abs(v)) * 32) + 40_000)
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.signum(v).cast("long") * size)


def exact_quantiles(df: DataFrame, group_cols, value_col: str, probs, limit: int = 100_000, bins: int = 1024) -> DataFrame:
    """Exact linear-interpolated quantiles (as ``percentile`` / numpy
    'linear') per group: one row per (group, p) with column ``q``.

    Selection by histogram refinement: a first pass counts the values of every
    coarse bin, with map-side combining, so only counts are shuffled.  Bins
    without a wanted rank are done with; the others become ranges of values
    that further passes cut into ``bins`` equal parts until each holds at most
    ``limit`` values, or one value only, however often.  The values of the last
    ranges are counted and ranked.  No pass sorts or shuffles the data.
    """
    names = [f"_g{i}" for i in range(len(list(group_cols)))] or ["_g0"]
    own = _as_cols(group_cols) or [F.lit(0)]
    v = F.col(value_col).cast("double") + F.lit(0.0)
    vals = df.select(*[c.alias(n) for c, n in zip(own, names)], v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))

    def holding(parts: DataFrame, by: list[str], order: str) -> DataFrame:
        """The parts (n values from _lo to _hi) that hold wanted ranks, with the rank of their first value."""
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = parts.withColumn("_start", F.col("_base") + F.sum("_n").over(w) - F.col("_n"))
        wanted = F.exists(_ranks(probs), lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_n")))
        return placed.where(wanted).select(*names, "_total", "_start", "_n", "_lo", "_hi")

    summed = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    parts = vals.groupBy(*names, _coarse(F.col("_v")).alias("_bin")).agg(*summed)
    parts = parts.withColumns({"_total": F.sum("_n").over(Window.partitionBy(*names)), "_base": F.lit(0).cast("long")})
    ranges, most = _small(holding(parts, names, "_bin"))
    while most > limit:
        at = F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins)
        parts = (_within(vals, ranges.where("_lo < _hi"), names).groupBy(*names, "_total", "_start", F.least(at, F.lit(bins - 1).cast("long")).alias("_bin"))
                 .agg(*summed).withColumnRenamed("_start", "_base"))
        finer = holding(parts, [*names, "_base"], "_bin")
        ranges, most = _small(finer.unionByName(ranges.where("_lo = _hi")))
    each = _within(vals, ranges.where("_lo < _hi"), names).groupBy(*names, "_total", "_start", "_v").agg(F.count(F.lit(1)).alias("_n"))
    # at most `limit` values in a range
    w = Window.partitionBy(*names, "_start").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = each.withColumn("_end", F.col("_start") + F.sum("_n").over(w)).select(*names, "_total", "_v", (F.col("_end") - F.col("_n")).alias("_from"), "_end")
    ones = ranges.where("_lo = _hi").select(*names, "_total", F.col("_lo").alias("_v"), F.col("_start").alias("_from"), (F.col("_start") + F.col("_n")).alias("_end"))
    runs = runs.unionByName(ones).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    pos = (F.col("_total") - 1).cast("double") * F.col("p")

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_end")), F.col("_v")))

    q = F.when(F.floor(pos) == F.ceil(pos), F.col("_vlo")).otherwise((F.ceil(pos) - pos) * F.col("_vlo") + (pos - F.floor(pos)) * F.col("_vhi"))
    out = runs.groupBy(*names, "_total", "p").agg(at_rank(F.floor(pos)).alias("_vlo"), at_rank(F.ceil(pos)).alias("_vhi"))
    plain = [c if isinstance(c, str) else f"_g{i}" for i, c in enumerate(group_cols)]
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, plain)], "p", q.alias("q"))


def _ranks(probs) -> Column:
    """The ranks that the quantiles of _total values interpolate between."""
    pos = [(F.col("_total") - 1).cast("double") * F.lit(float(p)) for p in probs]
    return F.array(*[f(x) for x in pos for f in (F.floor, F.ceil)])


def _small(ranges: DataFrame) -> tuple[DataFrame, int]:
    """The ranges, computed once, and the most values that one with different values holds."""
    rows = read_if_small(ranges)
    if rows is not None:
        open_ = [n for n, lo, hi in zip(*(rows.column(c).to_pylist() for c in ("_n", "_lo", "_hi"))) if lo < hi]
        return F.broadcast(local_frame(ranges, rows)), max(open_, default=0)
    ranges = materialize(ranges)
    return ranges, ranges.where("_lo < _hi").agg(F.max("_n")).first()[0] or 0


def _within(vals: DataFrame, ranges: DataFrame, names: list[str]) -> DataFrame:
    """The values that lie in a range of their group, beside it."""
    renamed = ranges.select(*[F.col(n).alias(f"_r{n}") for n in names], "_total", "_start", "_lo", "_hi")
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_r{n}")) for n in names])
    return vals.join(renamed, same & F.col("_v").between(F.col("_lo"), F.col("_hi"))).drop(*[f"_r{n}" for n in names])


def approx_quantiles(df: DataFrame, group_cols, value_col: str, probs, accuracy: int = 100_000) -> DataFrame:
    """Sketch-based quantiles (relative rank error 1/accuracy): one
    aggregation with map-side partial sketches, no sort of the data."""
    v = df.where(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col)))
    q = v.groupBy(*group_cols).agg(F.percentile_approx(F.col(value_col).cast("double"),
                                                       [float(p) for p in probs], accuracy).alias("_qs"))
    return q.select(*group_cols, F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"),
                                                         F.col("_qs").alias("q"))).alias("_z")).select(
        *group_cols, "_z.p", "_z.q")


def exact_quantile_table(df: DataFrame, group_cols, value_col: str, probs, names,
                         method: str = "exact") -> DataFrame:
    """Quantiles pivoted to one row per group, one column per name.
    ``method='approx'`` trades exactness for a single aggregation pass."""
    if method == "approx":
        q = approx_quantiles(df, group_cols, value_col, probs)
    else:
        q = exact_quantiles(df, group_cols, value_col, probs)
    cols = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(nm)
            for p, nm in zip(probs, names)]
    return q.groupBy(*group_cols).agg(*cols)


def unpivot_numeric(df: DataFrame, id_cols, value_cols, name_col: str = "feature",
                    value_col: str = "value") -> DataFrame:
    """Wide -> long (feature, value), values cast to double."""
    w = df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in value_cols])
    return w.unpivot(list(id_cols), list(value_cols), name_col, value_col)
