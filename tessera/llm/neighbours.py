"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Vectors are scaled by the largest norm and given one more component so that
all lie on a sphere, where the largest inner product with a query is the
smallest angle.  Each of ``trees`` trees gives every vector a long hash
string (64 signs of seeded random projections); sorted, the strings of a tree
are a prefix tree.  A query descends in every tree to the longest prefixes
that others share, and ascends in all trees together, one sign at a time,
until the vectors below its prefixes number at least ``share`` times the
index (counted once per tree that holds them), and hold ``k`` + 1 different
ones.  All of those are compared
with the query in double precision.

In Spark: the numbers of vectors below each prefix (up to ``levels`` signs)
are a small count table, from which every query's level follows by a join and
a sum.  The sorted strings are cut into blocks by tree and leading signs
(more signs for a larger index; a block over ``block_rows`` is split by hash),
queries go to the blocks below their prefix, and within a block a prefix is a
range of the sorted array, found by binary search.  A block returns each
query's nearest ``k`` + 1 only.

Equal vectors are one entry of the forest; their ids, the ``k`` + 1 smallest
of each, come back at the end, so a vector with very many copies costs as
much as any other, as candidate and as query.

``share`` is a share because recall must hold at any size: on vectors without
any structure (independent directions in 64 dimensions) the 20th nearest is
not much nearer than a random one, and a forest must look at most of the
index to find nine tenths of them.  On clustered vectors a far smaller share
gives the same recall.

Defined cases: vectors that are null, empty, zero, or hold a null or
non-finite component take no part; nor do those of another length than the
most frequent one; null ids take no part; repeated rows count once; a query's
own id is never its neighbour; ties go to the smaller id; fewer candidates
than ``k`` give all of them; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import written

HASH_BITS = 64


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, e): distinct rows whose vectors take part."""
    e = F.col("e")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = (df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e"))
            .where(F.col("id").isNotNull() & e.isNotNull())
            .where(F.forall(e, fine) & F.exists(e, lambda x: x != 0)))
    size = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("e") == (size["d"] if size else 0))


def _unit(e: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Points on the unit sphere whose angles order inner products."""
    norm = np.linalg.norm(e, axis=1)
    if query:
        return np.hstack((e / norm[:, None], np.zeros((len(e), 1))))
    e = e / longest
    return np.hstack((e, np.sqrt(np.maximum(0.0, 1.0 - (e * e).sum(axis=1)))[:, None]))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _strings(rows: DataFrame, trees: int, seed: int, longest: float, dim: int, query: bool) -> DataFrame:
    """(g, tree, h, e): a row per vector and tree."""
    planes = rows.sparkSession.sparkContext.broadcast(
        np.random.default_rng(seed).standard_normal((dim + 1, trees * HASH_BITS)))

    def hashed(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                n = part.num_rows
                signs = (_unit(_matrix(part.column("e")), longest, query) @ planes.value > 0).reshape(n, trees, HASH_BITS)
                h = np.packbits(signs, axis=2).view(">u8").astype(np.uint64).reshape(n * trees)
                at = pa.array(np.repeat(np.arange(n), trees))
                yield pa.RecordBatch.from_arrays(
                    [part.column("g").take(at), pa.array(np.tile(np.arange(trees, dtype=np.int64), n)),
                     pa.array(h.view(np.int64)), part.column("e").take(at)], names=["g", "tree", "h", "e"])

    return rows.mapInArrow(hashed, f"g long, tree long, h long, e {rows.schema['e'].dataType.simpleString()}")


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("h", HASH_BITS - bits) if bits else F.lit(0).cast("long")


def _scored(points: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Each query's nearest k (ties at the end included) below its prefix in one block."""
    h = points.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h, kind="stable")
    h = h[order]
    own = _matrix(points.column("e").combine_chunks())[order]
    g = points.column("g").to_numpy()[order]
    asked = _matrix(queries.column("e").combine_chunks())
    level = queries.column("level").to_numpy().astype(np.int64)
    hq = queries.column("h").to_numpy().view(np.uint64)
    drop = np.where(level > 0, HASH_BITS - level, HASH_BITS - 1).astype(np.uint64)
    low = np.where(level > 0, hq >> drop << drop, np.uint64(0))
    high = np.where(level > 0, low | ((np.uint64(1) << drop) - np.uint64(1)), ~np.uint64(0))
    first, last = np.searchsorted(h, low, "left"), np.searchsorted(h, high, "right")
    q_out, g_out, s_out = [], [], []
    for a, b in sorted(set(zip(first.tolist(), last.tolist()))):
        if a == b:
            continue
        rows = np.flatnonzero((first == a) & (last == b))
        for i in range(0, len(rows), 256):
            part = rows[i:i + 256]
            score = asked[part] @ own[a:b].T
            if b - a > k:
                edge = np.partition(score, b - a - k, axis=1)[:, b - a - k]
                # a little below the edge: the products are summed again below
                x, y = np.nonzero(score >= (edge - 1e-9 * (1.0 + np.abs(edge)))[:, None])
            else:
                x, y = np.nonzero(np.ones_like(score, dtype=bool))
            q_out.append(queries.column("g").to_numpy()[part[x]])
            g_out.append(g[a:b][y])
            s_out.append((asked[part[x]] * own[a:b][y]).sum(axis=1))      # one order of summing for a pair, wherever it is met
    none = np.zeros(0, np.int64)
    return pa.table({"q": np.concatenate(q_out or [none]), "g": np.concatenate(g_out or [none]),
                     "score": np.concatenate(s_out or [none.astype(np.float64)])})


def nearest(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            trees: int = 12, share: float = 1.2, levels: int = 12, block_rows: int = 8192, seed: int = 42) -> DataFrame:
    """query_id, rank (from 1), ``id_col``, score: the ``k`` nearest found for
    each row of ``df`` that the condition ``queries`` (over ``id_col``) selects."""
    rows = usable(df, id_col, vector_col)
    groups = written(rows.groupBy("e").agg(F.min("id").alias("g")), "vectors")          # distinct vectors
    ids = written(rows.join(groups, "e").select("g", "id").distinct(), "ids")
    asked_ids = ids.withColumn(id_col, F.col("id")).where(queries).select("g", "id")
    n, longest, dim = groups.agg(F.count("*"), F.sqrt(F.max(F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double") * x))),
                                 F.max(F.size("e"))).first()
    n, longest, dim = n or 0, longest or 1.0, dim or 1
    index = written(_strings(groups.select("g", "e"), trees, seed, longest, dim, False), "forest")
    asked = written(_strings(groups.join(asked_ids.select("g").distinct(), "g", "left_semi").select("g", "e"),
                             trees, seed, longest, dim, True), "asked")
    # trees x (k + 1) in all trees together are k + 1 in one of them at least; at the root a query sees everything
    enough = min(trees * n, max(share * n, trees * (k + 1)))
    # vectors below each prefix of up to `levels` signs: at most trees x 2^(levels + 1) rows
    finest = index.groupBy("tree", _prefix(levels).alias("p")).agg(F.count("*").alias("n"))
    by_level = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.shiftright("p", levels - x).alias("p")) for x in range(levels + 1)]))
    counts = (finest.select("tree", "n", by_level.alias("x")).groupBy("tree", "x.level", "x.p").agg(F.sum("n").alias("n")))
    seen = (asked.select("g", "tree", F.explode(F.array(*[F.struct(F.lit(x).alias("level"), _prefix(x).alias("p")) for x in range(levels + 1)]))
                         .alias("x")).select("g", "tree", "x.level", "x.p").join(counts, ["tree", "level", "p"]))
    level = (seen.groupBy("g", "level").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(float(enough)))
             .groupBy("g").agg(F.max("level").alias("level")))
    # blocks: leading signs so that an even block holds about half of block_rows; fuller ones are split
    cut = int(min(levels, max(0, np.ceil(np.log2(max(1.0, 2.0 * n / block_rows))))))
    split = (index.groupBy("tree", _prefix(cut).alias("block")).agg(F.count("*").alias("rows"))
             .select("tree", "block", F.ceil(F.col("rows") / block_rows).cast("long").alias("parts")))
    points = (index.withColumn("block", _prefix(cut)).join(F.broadcast(split), ["tree", "block"])      # trees x 2^cut rows
              .select("tree", "block", F.pmod(F.xxhash64("g"), "parts").alias("part"), "h", "g", "e"))
    below = F.when(F.col("level") >= cut, F.array(_prefix(cut))).otherwise(F.transform(
        F.sequence(F.lit(0), F.expr(f"cast(shiftleft(1L, {cut} - least(level, {cut})) - 1 as int)")),
        lambda i: F.expr(f"shiftleft(shiftright(case when {cut} = 0 then 0L else shiftrightunsigned(h, {HASH_BITS - max(cut, 1)}) end,"
                         f" {cut} - least(level, {cut})), {cut} - least(level, {cut}))") + i))
    sent = (asked.join(level, "g").withColumn("block", F.explode(below)).join(F.broadcast(split), ["tree", "block"])
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .select("tree", "block", "part", "h", "g", "level", "e"))
    keys = ["tree", "block", "part"]

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "g": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _scored(left, right, k + 1)

    found = (points.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(scored, "q long, g long, score double")
             .groupBy("q", "g").agg(F.max("score").alias("score")))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "g")
    near = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)     # k + 1 vectors hold k + 1 ids at least
    members = (ids.withColumn("m", F.row_number().over(Window.partitionBy("g").orderBy("id"))).where(F.col("m") <= k + 1).drop("m"))
    lists = near.select("q", "g", "score").join(members, "g").select("q", "id", "score")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    lists = written(lists.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("q")
                    .agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("near")), "lists")
    # a query's own id leaves its vector's list; the first k of the rest are its neighbours
    got = asked_ids.select(F.col("g").alias("q"), F.col("id").alias("query_id")).join(lists, "q")
    rest = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return (got.select("query_id", F.posexplode(rest).alias("i", "x"))
            .select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), "x.score"))
