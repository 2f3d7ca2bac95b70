"""Hard negatives by inner product, with length buckets and coordinate pruning.

Rows hold integer vectors.  An anchor's positives are its best other rows of
the same label; the negatives of an anchor and a positive are the best rows of
other labels whose score lies within two shares of the positive's score.

Rows are put into length buckets (norms within a factor of 2^(1/4)), a bucket
into blocks of about ``block_rows`` by id, and anchors into groups of about
``anchor_rows``; a block and a group meet in one task, so no task holds more
than that, whatever label or vector is frequent.  An anchor is sent only to
buckets whose longest vector times its own length reaches its threshold.  In a
task every coordinate of the block's unit vectors is a sorted list.  A score of
the threshold at least bounds the angle to the anchor, and the angle bounds
every coordinate: the feasible value ranges of the anchor's largest coordinates
(its focus) are found in the sorted lists by binary search and intersected, and
what is left is verified with exact integer scores.

The thresholds come from a first search over one row in ``pilot`` (by a hash of
the id): its last wanted score bounds the true one from below, so the second
search over all rows is exact at any size.  Without a bound above zero (few
rows of a label, say) every row is verified.  On vectors without structure the
ranges rule little out and the search is a comparison of the anchors with all
rows in blocks; on clustered or unevenly long ones most rows are never touched.

Defined cases: rows with a null id or label, a null vector or a null component
take no part; of rows with one id that of the smallest label, then vector,
counts; shorter vectors are read as if filled up with zeros, so empty ones
score 0; ties go to the smaller id; components beyond 2^62 count as that, and
scores beyond a long as the largest long; an anchor without positives, or a
positive without negatives, gives no row; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import written

FOCUS = 3
MOST = 1 << 62
EXACT = float(1 << 52)       # sums below this are exact in double precision
SLACK = 1e-9


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component; null if one is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    most = F.lit(float(MOST))
    return F.when(fine, F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale).cast("double"), most), -most).cast("long")))


class Block:
    """Rows of one length bucket with sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.values = vectors.astype(np.float64)
        norm = np.sqrt((self.values * self.values).sum(axis=1))
        self.longest = float(norm.max()) if len(norm) else 0.0
        self.unit = self.values / np.maximum(norm, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, q: np.ndarray, norm: float, least: float) -> np.ndarray | None:
        """Rows that may score ``least`` with ``q``; None: all."""
        if not least > 0:
            return None
        reach = norm * self.longest
        if reach * (1 + SLACK) < least:
            return np.zeros(0, np.int64)
        t = min(1.0, least / reach * (1 - SLACK))
        unit = q / norm
        ranges = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            side = np.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] * unit[f])))
            low = -2.0 if unit[f] <= -t else unit[f] * t - side - SLACK
            high = 2.0 if unit[f] >= t else unit[f] * t + side + SLACK
            order, values = self.sorted_list(int(f))
            ranges.append((np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right"), int(f), low, high))
        ranges.sort(key=lambda r: r[1] - r[0])
        a, b, f, _, _ = ranges[0]
        if b - a == len(self.ids):
            return None
        got = self.sorted_list(f)[0][a:b]
        for _, _, f, low, high in ranges[1:]:
            x = self.unit[got, f]
            got = got[(x >= low) & (x <= high)]
        return got

    def scores(self, q: np.ndarray, norm: float, rows: np.ndarray | None) -> np.ndarray:
        """Exact integer scores."""
        if norm * self.longest < EXACT:
            values = self.values if rows is None else self.values[rows]
            return np.rint(values @ q.astype(np.float64)).astype(np.int64)
        vectors = self.vectors if rows is None else self.vectors[rows]
        most = 2 ** 63 - 1
        mine = [int(x) for x in q]
        return np.array([max(-most, min(most, sum(x * int(y) for x, y in zip(mine, v)))) for v in vectors], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(pool: DataFrame, asked: DataFrame, buckets: list, aparts: int, k: int, negatives: bool) -> DataFrame:
    """(a, positive, score, id, found): the k best of each anchor (of each of its
    bands, for negatives) in every block it reaches."""
    spans = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("parts"), F.lit(x).alias("longest")) for b, n, x in buckets])
    near = F.filter(spans, lambda s: (F.col("least") <= 0) | (F.col("norm") * s["longest"] * (1 + SLACK) >= F.col("least")))
    sent = (asked.select("*", F.explode(near).alias("s")).select("*", F.explode(F.sequence(F.lit(0), F.col("s.parts") - 1)).alias("part"))
            .select(F.col("s.bucket").alias("bucket"), "part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(aparts)).cast("int").alias("apart"),
                    "id", "label", "v", "norm", "least", "bands"))
    wanted = sent.select("bucket").distinct()                      # a bounded number of length buckets
    dealt = (pool.join(F.broadcast(wanted), "bucket", "left_semi")
             .select("bucket", "part", *[F.col(c).alias(c) for c in ("id", "label", "v")])      # both sides come from one table
             .withColumn("apart", F.explode(F.sequence(F.lit(0), F.lit(aparts - 1)))))
    names = ["a", "positive", "score", "id", "found"]
    keys = ["bucket", "part", "apart"]

    def matched(points: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if points.num_rows and queries.num_rows:
            block = Block(points.column("id").to_numpy(), points.column("label").to_numpy(), _matrix(points.column("v")))
            bands = queries.column("bands").to_pylist()
            for i, (a, label, q, norm, least) in enumerate(zip(*(queries.column(c).to_numpy() for c in ("id", "label")), _matrix(queries.column("v")),
                                                               *(queries.column(c).to_numpy() for c in ("norm", "least")))):
                rows = block.candidates(q, norm, least)
                ids, labels = (x if rows is None else x[rows] for x in (block.ids, block.labels))
                scores = block.scores(q, norm, rows)
                if negatives:
                    other = labels != label
                    for band in bands[i]:
                        at = np.flatnonzero(other & (scores >= band["low"]) & (scores <= band["high"]))
                        out += [(a, band["positive"], band["score"], ids[j], scores[j]) for j in at[best(scores[at], ids[at], k)]]
                else:
                    at = np.flatnonzero((labels == label) & (ids != a))
                    out += [(a, None, None, ids[j], scores[j]) for j in at[best(scores[at], ids[at], k)]]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names=names)

    return (dealt.groupBy(*keys).cogroup(sent.groupBy(*keys))
            .applyInArrow(matched, ", ".join(f"{n} long" for n in names)))


def mine(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100),
         id_col: str = "vec_id", label_col: str = "label", vector_col: str = "v", pilot: int = 64, block_rows: int = 16_384,
         anchor_rows: int = 2_048) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score for the rows that the condition ``anchors`` (over
    ``id_col``) selects; ``vector_col`` is an array of longs.  Negatives lie
    between the shares ``low`` and ``high`` (numerator, denominator)."""
    rows = (df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())))
    rows = written(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*"), "vectors")
    dim = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    rows = (rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
            .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
            .withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log2("norm") * 4).cast("int")).otherwise(-1)))
    # norms of longs lie between 1 and 2^62 times the root of the dimension: a few hundred buckets at most
    found = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    buckets = [(b, -(-n // block_rows), x) for b, n, x in found]
    parts = F.element_at(F.create_map(*[F.lit(x) for b, n, _ in buckets for x in (b, n)]), F.col("bucket")) if buckets else F.lit(1)
    pool = written(rows.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")), "pool")
    own = pool.withColumn(id_col, F.col("id")).where(anchors).select("id", "label", "v", "norm")
    aparts = max(1, -(-own.count() // anchor_rows))
    buckets = buckets or [(-1, 1, 0.0)]
    sample = pool.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(pilot)) == 0)
    none = "cast(null as array<struct<positive:long,score:long,low:long,high:long>>)"
    by_score = lambda *by: Window.partitionBy(*by).orderBy(F.desc("found"), "id")

    def ranked(got: DataFrame, k: int, *by: str) -> DataFrame:
        return got.withColumn("rank", F.row_number().over(by_score(*by))).where(F.col("rank") <= k)

    # positives: the last wanted score in the sample bounds that of all rows from below
    unbound = own.withColumns({"least": F.lit(float("-inf")), "bands": F.expr(none)})
    bound = (ranked(_search(sample, unbound, buckets, aparts, positives, False), positives, "a").where(F.col("rank") == positives)
             .select(F.col("a").alias("id"), F.col("found").cast("double").alias("least")))
    asked = own.join(bound, "id", "left").withColumns({"least": F.coalesce("least", F.lit(float("-inf"))), "bands": F.expr(none)})
    pairs = ranked(_search(pool, asked, buckets, aparts, positives, False), positives, "a").select("a", F.col("id").alias("positive"), F.col("found").alias("score"))
    # bounds of integer shares without rounding: n * denominator >= numerator * score
    exact = lambda share, up: F.expr(f"cast({'ceil' if up else 'floor'}(cast(score as decimal(20, 0)) * {int(share[0])} / {int(share[1])}) as decimal(20, 0))")
    fits = lambda c: F.greatest(F.least(c, F.lit(2 ** 63 - 1).cast("decimal(20,0)")), F.lit(-2 ** 63 + 1).cast("decimal(20,0)")).cast("long")
    bands = (pairs.withColumns({"low": fits(exact(low, True)), "high": fits(exact(high, False))}).where("low <= high")
             .groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_list(F.struct("positive", "score", "low", "high"))).alias("bands")))
    banded = written(own.join(bands, "id"), "bands")
    least = lambda of: F.array_min(F.transform("bands", of)).cast("double")
    first = banded.withColumn("least", least(lambda b: b["low"]))
    seen = (ranked(_search(sample, first.select("id", "label", "v", "norm", "least", "bands"), buckets, aparts, negatives, True), negatives, "a", "positive")
            .where(F.col("rank") == negatives).groupBy(F.col("a").alias("id"))
            .agg(F.map_from_entries(F.collect_list(F.struct("positive", "found"))).alias("tenth")))
    closer = banded.join(seen, "id", "left").withColumn("least", least(lambda b: F.greatest(b["low"], F.coalesce(F.try_element_at("tenth", b["positive"]), b["low"]))))
    got = ranked(_search(pool, closer.select("id", "label", "v", "norm", "least", "bands"), buckets, aparts, negatives, True), negatives, "a", "positive")
    return got.select(F.col("a").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                      F.col("id").alias("negative_id"), F.col("score").alias("positive_score"), F.col("found").alias("negative_score"))
