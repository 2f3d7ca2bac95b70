"""Hash-seeded split, stratified folds, per-group caps and first-N.

Randomness is ``hash_key(id, salt)`` (see ``tessera.functions.hashing``), so
results do not depend on partitioning, task retries or the engine.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_key
from tessera.operators.joins import broadcast_checked
from tessera.operators.ordinal import rank_within

CUT_BITS = 16


def train_test_split(df: DataFrame, id_col: str, test_size: float = 0.2, salt: str = "split",
                     split_col: str = "split") -> DataFrame:
    """Not stratified; exactly ceil(test_size * n) rows (lowest (hash, id))
    go to 'test'.

    A count of the hashes' leading bits finds the bucket that holds the cut,
    and only that bucket's (hash, id) keys are sorted, to find the cut tuple;
    the split itself is a row-wise comparison, so the wide table is neither
    shuffled nor rewritten.  A NULL id is an error.
    """
    h = hash_key(F.col(id_col), salt)
    keys = df.select(h.alias("_h"), F.col(id_col).alias("_id"))
    # rows by the top bits of their hash: a count table of at most 2 ** CUT_BITS rows finds the bucket of the cut
    bucket = F.shiftright("_h", 32 - CUT_BITS)
    counts = keys.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max(F.col("_id").isNull()).alias("no_id")).collect()
    if any(r["no_id"] for r in counts):
        raise ValueError(f"train_test_split: {id_col} holds NULL")
    left = math.ceil(test_size * sum(r["c"] for r in counts))
    if not left:
        return df.withColumn(split_col, F.lit("train"))
    for r in sorted(counts, key=lambda r: r["b"]):
        if left <= r["c"]:
            at = r["b"]
            break
        left -= r["c"]
    # only that bucket is put in order
    th, tid = (keys.where(bucket == at).orderBy("_h", "_id").limit(left).orderBy(F.desc("_h"), F.desc("_id")).first())
    is_test = (h < F.lit(th)) | ((h == F.lit(th)) & (F.col(id_col) <= F.lit(tid)))
    return df.withColumn(split_col, F.when(is_test, "test").otherwise("train"))


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = 5, salt: str = "fold",
                     fold_col: str = "fold") -> DataFrame:
    """Shuffled stratified k-fold: rows sorted by (label, hash, id) are dealt
    round-robin, fold = (class offset + rank in class) mod k, so every fold's
    class counts differ by at most one."""
    # only the keys are ranked; the folds meet the rows by id
    h = df.select(F.col(id_col), F.col(label), hash_key(F.col(id_col), salt).alias("_h")).distinct()
    r = rank_within(h, ["_h", id_col], [label], rank_col="_r", size_col="_n")
    sizes = r.select(label, "_n").distinct()
    largest = sizes.agg(F.max("_n")).first()[0]
    if largest is not None and largest < k:
        raise ValueError(f"k={k} folds exceed the number of rows of every class (largest class: {largest})")
    # one row per class: cumulative offset of earlier classes
    offs = sizes.select(label, F.coalesce(F.sum("_n").over(
        Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    offs = offs.withColumnRenamed(label, "_ol")
    folds = (r.join(broadcast_checked(offs), F.col(label).eqNullSafe(F.col("_ol")))
             .select(F.col(id_col).alias("_fid"), F.col(label).alias("_flab"), ((F.col("_off") + F.col("_r")) % k).cast("int").alias(fold_col)))
    return (df.join(folds, df[id_col].eqNullSafe(folds["_fid"]) & df[label].eqNullSafe(folds["_flab"])).drop("_fid", "_flab"))


def capped_sample(df: DataFrame, id_col: str, group: str, cap: int, salt: str = "cap") -> DataFrame:
    """Per-group sample without replacement of ``cap`` rows, only when the
    group is larger; hash order within the group.  The filter on
    row_number lets Spark run a partial per-partition top-N before the
    shuffle (WindowGroupLimit), so a hot group moves at most
    cap x #partitions rows."""
    w = Window.partitionBy(group).orderBy(F.col("_h"), F.col(id_col))
    return (df.withColumn("_h", hash_key(F.col(id_col), F.concat(F.lit(f"{salt}|"), F.col(group).cast("string"))))
            .withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= cap).drop("_h", "_rn"))


def first_n_per_group(df: DataFrame, group: str, order_cols, n: int, rank_col: str = "rn") -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def remap_categories(df: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """Inner join to a category map; unmapped rows drop out.  The map (one
    row per source category) is broadcast after its size is checked."""
    return df.join(broadcast_checked(mapping), key, "inner")
