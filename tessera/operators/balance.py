"""Within-class exact k-nearest neighbours and SMOTE oversampling.

kNN compares a query with few rows of its class where the data allow it, by a
pivot partition.  Some rows of every class (the square root of its size, at most
``pivots``) are pivots; every row belongs to the cell of its nearest pivot and
keeps its distance to it.  The k-th nearest in a query's own block of rows bounds
its true k-th neighbour by r.  By the triangle inequality a cell further away than
its radius plus r holds no neighbour, nor does a row of a cell whose distance to
the pivot differs from the query's by more than r; the others are compared
exactly.  No cap on candidates.  On classes that are isotropic in many dimensions
the k-th neighbour is nearly as far as a typical point, and every exact method
compares nearly all pairs; ``pairs_compared`` gives the share.

Cells share blocks of about ``cell_target`` rows (a larger cell is cut) and queries
are dealt to groups of the same size; a query is sent once to a block, however many
of its cells are near, and a block meets a group at a time, so no task holds more of
either.  Distances first come from matrix products; the pairs that may be among the
nearest within their rounding are compared exactly, by sums in array order.  Pivots are
a bounded number of rows per class and meet the rows by a shuffle.  Rows without a class have no
neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import TWO_32, hash_key
from tessera.operators.ordinal import rank_within
from tessera.session import materialize, ship_package
from tessera.operators.prep import _bounded_collect

_SLACK = 1e-9            # of the distances compared: far above the rounding of their sums
_CHUNK = 256             # queries compared at once
_MANY = 32               # candidates of a query in a cell, from which its bound is lowered
_LARGE = 1 << 32         # block ids of a cell of many rows: its number times this, and a part of it


def _vectors(table: pa.Table, column: str) -> np.ndarray:
    lists = table.column(column).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _sq_dists(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``x`` (columns in rows: features x rows)
    to every row of ``q`` (likewise), summed in array order: queries x rows."""
    out = np.zeros((q.shape[1], x.shape[1]))
    for a, b in zip(x, q):
        d = a[None, :] - b[:, None]
        d *= d
        out += d
    return out


def _turned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.T)


def _near_sq(x: np.ndarray, xx: np.ndarray, q: np.ndarray, qq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances by a matrix product, for every query a bound of what they
    and sums in array order differ by)."""
    d = q @ x.T
    d *= -2
    d += xx
    d += qq[:, None]
    return d, 4 * (x.shape[1] + 4) * np.finfo(float).eps * (np.sqrt(qq) + np.sqrt(xx.max())) ** 2


def _nearest(x: np.ndarray, rank: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray, near: np.ndarray, error: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, row, squared distance) of the ``k`` nearest rows of every query, the
    smaller ``rank`` first at equal distance, among the pairs (i, j) of a distance
    ``near``, which is right to ``error`` of the query."""
    order = np.lexsort((near, i))
    i, j, near = i[order], j[order], near[order]
    first, after = (np.searchsorted(i, np.arange(len(q)), side) for side in ("left", "right"))
    last = np.minimum(first + k, after) - 1
    limit = np.where(last >= first, near[np.maximum(last, 0)] if len(near) else 0.0, 0.0) + 2 * error
    keep = near <= limit[i]
    i, j = i[keep], j[keep]
    dist = np.zeros(len(i))
    for a in range(0, len(i), 1 << 14):
        d = _turned(x[j[a:a + (1 << 14)]]) - _turned(q[i[a:a + (1 << 14)]])
        for c in d:
            dist[a:a + (1 << 14)] += c * c
    order = np.lexsort((rank[j], dist, i))
    i, j, dist = i[order], j[order], dist[order]
    keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(q)))[i] < k
    return i[keep], j[keep], dist[keep]


def _numbered(ids: list) -> np.ndarray:
    """The place of every id in their order; rows may share one."""
    at = {n: i for i, n in enumerate(sorted(set(ids)))}
    return np.array([at[n] for n in ids], np.int64)


def _own(df: DataFrame) -> DataFrame:
    """``df`` under column references of its own: both sides of a cogroup come from one table here."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _dealt(rows: DataFrame, target: int) -> DataFrame:
    """``_block``: cells of few rows share blocks of about ``target`` rows, a cell of more is cut by a hash of the id."""
    sizes = rows.groupBy("_c", "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / target))
    before = Window.partitionBy("_c").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)              # at most ``pivots`` cells
    few = F.coalesce(F.sum(F.when(F.col("_parts") == 1, F.col("_n"))).over(before), F.lit(0))
    sizes = sizes.withColumn("_shared", -1 - F.floor(few / target)).drop("_n")
    part = F.col("_cell") * F.lit(_LARGE) + F.pmod(F.xxhash64("_id"), F.col("_parts"))
    return rows.join(sizes, ["_c", "_cell"]).withColumn("_block", F.when(F.col("_parts") == 1, F.col("_shared")).otherwise(part).cast("long")).drop("_parts", "_shared")


def _pivot_pairs(cand: DataFrame, queries: DataFrame, k: int, pivots: int, cell_target: int) -> DataFrame:
    """(_id, nbr_id, dist2, compared): the k nearest of every query in each
    block it was compared with, and one row per query and block (nbr_id null)
    with the number of rows compared."""
    ship_package(cand.sparkSession)
    id_type = cand.schema["_id"].dataType.simpleString()
    c_type = cand.schema["_c"].dataType.simpleString()
    order = Window.partitionBy("_c").orderBy(F.xxhash64("_id"), "_id")
    ranked = cand.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= pivots)
    sizes = cand.groupBy("_c").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_few"), F.ceil(F.count(F.lit(1)) / cell_target).cast("int").alias("_parts"))
    chosen = materialize(ranked.join(sizes, "_c").where(F.col("_r") <= F.col("_few")).select("_c", F.col("_r").alias("_cell"), F.col("_v").alias("_pv"), "_parts"))
    to_parts = lambda df: df.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

    def nearest_pivot(rows: pa.Table, piv: pa.Table) -> pa.Table:
        x, p, cells = _turned(_vectors(rows, "_v")), _turned(_vectors(piv, "_pv")), piv.column("_cell").to_numpy()
        best, cell = np.full(x.shape[1], np.inf), np.zeros(x.shape[1], np.int32)
        for a in range(0, len(best), 4 * _CHUNK):
            part = slice(a, a + 4 * _CHUNK)
            for d, c in zip(_sq_dists(x[:, part], p), cells):
                near = d < best[part]
                best[part][near], cell[part][near] = d[near], c
        return rows.select(["_id", "_v", "_c"]).append_column("_cell", pa.array(cell, pa.int32())).append_column("_dist", pa.array(np.sqrt(best)))

    dealt = _own(cand).join(sizes.select("_c", "_parts"), "_c").withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    v_type = "array<double>"
    celled = dealt.groupBy("_c", "_part").cogroup(_own(to_parts(chosen)).groupBy("_c", "_part")).applyInArrow(
        nearest_pivot, f"_id {id_type}, _v {v_type}, _c {c_type}, _cell int, _dist double")
    celled = materialize(_dealt(materialize(celled), cell_target))
    radii = celled.groupBy("_c", "_cell", "_block").agg(F.max("_dist").alias("_radius"))

    def own_bound(rows: pa.Table) -> pa.Table:
        x, asked = _vectors(rows, "_v"), np.flatnonzero(rows.column("_asked").to_numpy(zero_copy_only=False))
        bound = np.full(len(asked), np.inf)
        xx, ids = (x * x).sum(1), _numbered(rows.column("_id").to_pylist())
        each = max(1, min(_CHUNK, (1 << 22) // len(x)))
        for a in range(0, len(asked) if len(x) > k else 0, each):
            i = asked[a:a + each]
            d, error = _near_sq(x, xx, x[i], xx[i])
            d[ids == ids[i][:, None]] = np.inf
            bound[a:a + each] = np.sqrt(np.maximum(np.partition(d, k - 1, 1)[:, k - 1], 0) + error)
        return rows.select(["_id", "_v", "_c"]).take(pa.array(asked)).append_column("_bound", pa.array(bound))

    asked = queries.select("_id").distinct().withColumn("_asked", F.lit(True))
    marked = celled.join(asked, "_id", "left").withColumn("_asked", F.coalesce("_asked", F.lit(False)))
    bounded = materialize(marked.groupBy("_c", "_cell", "_block").applyInArrow(own_bound, f"_id {id_type}, _v {v_type}, _c {c_type}, _bound double"))

    def near_cells(rows: pa.Table, piv: pa.Table) -> pa.Table:
        """Every query once, with its blocks and their cells as a list: the copies of its vector are made row by row after this."""
        ends, inner, blocks, cells, dist = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [], [], []
        if rows.num_rows and piv.num_rows:
            piv = piv.sort_by([("_block", "ascending"), ("_cell", "ascending")])
            p, radius, bound = _turned(_vectors(piv, "_pv")), piv.column("_radius").to_numpy(), rows.column("_bound").to_numpy()
            cell, block, q = piv.column("_cell").to_numpy(), piv.column("_block").to_numpy(), _turned(_vectors(rows, "_v"))
            for a in range(0, len(bound), _CHUNK):
                r = bound[a:a + _CHUNK, None]
                d = np.sqrt(_sq_dists(p, q[:, a:a + _CHUNK]))
                i, j = np.nonzero(~(d - radius > r + _SLACK * (d + radius)))
                new = np.flatnonzero(np.diff(i, prepend=-1) | (np.diff(block[j], prepend=0) != 0))      # a query's next block begins
                ends.append(ends[-1][-1] + np.cumsum(np.bincount(i[new], minlength=len(r))))
                inner.append(inner[-1][-1] + np.append(new, len(i))[1:])
                blocks.append(block[j[new]])
                cells.append(cell[j])
                dist.append(d[i, j])
        ends, inner = (np.concatenate(x).astype(np.int32) for x in (ends, inner))
        got = rows if len(ends) > 1 else rows.slice(0, 0)
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        lists = [pa.ListArray.from_arrays(pa.array(inner), flat(x, t)) for x, t in ((cells, pa.int32()), (dist, pa.float64()))]
        sent = pa.StructArray.from_arrays([flat(blocks, pa.int64()), *lists], names=["block", "cells", "dqs"])
        return pa.table([*got.select(["_id", "_v", "_c", "_bound", "_part"]).columns, pa.ListArray.from_arrays(pa.array(ends), sent)], names=["_id", "_v", "_c", "_bound", "_group", "_to"])

    cells = chosen.select("_c", "_cell", "_pv", "_parts").join(radii, ["_c", "_cell"])
    groups = bounded.join(sizes.select("_c", "_parts"), "_c").withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    sent = groups.groupBy("_c", "_part").cogroup(_own(to_parts(cells)).groupBy("_c", "_part")).applyInArrow(
        near_cells, f"_id {id_type}, _v {v_type}, _c {c_type}, _bound double, _group int, _to array<struct<block: bigint, cells: array<int>, dqs: array<double>>>")
    sent = sent.select("_id", "_v", "_c", "_bound", "_group", F.explode("_to").alias("_n")).select(
        "_id", "_v", "_c", "_bound", "_group", F.col("_n.block").alias("_block"), F.col("_n.cells").alias("_cells"), F.col("_n.dqs").alias("_dqs"))

    def compared(rows: pa.Table, asked: pa.Table) -> pa.Table:
        """The k nearest rows of the block of every query, found among its cells there
        by distances from matrix products and then by exact ones."""
        found, count = [], np.zeros(asked.num_rows, np.int64)
        if rows.num_rows and asked.num_rows:
            order = np.lexsort((rows.column("_dist").to_numpy(), rows.column("_cell").to_numpy()))
            rows = rows.take(pa.array(order))
            x, cell, from_pivot = _vectors(rows, "_v"), rows.column("_cell").to_numpy(), rows.column("_dist").to_numpy()
            names, askers = rows.column("_id").to_pylist(), asked.column("_id").to_pylist()
            rank = _numbered(names)
            at = dict(zip(names, rank.tolist()))
            own = np.array([at.get(n, -1) for n in askers])
            xx, own_cells = (x * x).sum(1), np.unique(cell)
            begins, ends = np.searchsorted(cell, own_cells), np.searchsorted(cell, own_cells, "right")
            q, bound = _vectors(asked, "_v"), asked.column("_bound").to_numpy()
            lists = asked.column("_cells").combine_chunks()
            dq = np.full((len(q), len(own_cells)), np.inf)              # to the pivots of the cells to look at
            look = np.zeros(dq.shape, bool)
            of = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy(zero_copy_only=False)), np.searchsorted(own_cells, lists.flatten().to_numpy())
            dq[of], look[of] = asked.column("_dqs").combine_chunks().flatten().to_numpy(), True
            turn = np.lexsort((dq.min(1), dq.argmin(1)))
            for a in range(0, len(q), _CHUNK):
                chunk = turn[a:a + _CHUNK]
                v, vv, r = q[chunk], (q[chunk] * q[chunk]).sum(1), bound[chunk].copy()
                error = np.zeros(len(chunk))
                pairs = []
                for c in np.argsort(dq[chunk].min(0)):                  # near cells first: they lower the bounds
                    some = np.flatnonzero(look[chunk, c])
                    if not len(some):
                        continue
                    to, here = dq[chunk[some], c], from_pivot[begins[c]:ends[c]]
                    slack = r[some] + _SLACK * (to + here[-1])
                    lo, hi = np.searchsorted(here, to - slack, "left").min(), np.searchsorted(here, to + slack, "right").max()
                    if lo >= hi:
                        continue
                    lo, hi = begins[c] + lo, begins[c] + hi
                    d, e = _near_sq(x[lo:hi], xx[lo:hi], v[some], vv[some])
                    error[some] = np.maximum(error[some], e)
                    count[chunk[some]] += hi - lo
                    limit = r[some] * r[some] * (1 + _SLACK) + e
                    i, j = np.nonzero(d <= limit[:, None])
                    if len(i) > _MANY * len(some) and hi - lo > k:
                        d[rank[lo:hi] == own[chunk[some]][:, None]] = np.inf
                        limit = np.minimum(limit, np.maximum(np.partition(d, k - 1, 1)[:, k - 1], 0) + 2 * e)
                        r[some] = np.minimum(r[some], np.sqrt(limit))
                        i, j = np.nonzero(d <= limit[:, None])
                    other = rank[lo + j] != own[chunk[some[i]]]
                    i, j = i[other], j[other]
                    pairs.append((some[i], lo + j, d[i, j]))
                if pairs:
                    i, j, dist = _nearest(x, rank, v, *(np.concatenate(t) for t in zip(*pairs)), error, k)
                    found.append((chunk[i], j, dist))
        i, j, dist = (np.concatenate(t) for t in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        ids, kind = asked.column("_id").combine_chunks(), rows.schema.field("_id").type
        if not rows.num_rows:
            ids = ids.slice(0, 0)
        return pa.table([pa.chunked_array([ids.take(pa.array(i)), ids], kind), pa.chunked_array([rows.column("_id").combine_chunks().take(pa.array(j)), pa.nulls(len(ids), kind)], kind),
                         pa.chunked_array([pa.array(dist), pa.nulls(len(ids), pa.float64())]), pa.chunked_array([pa.nulls(len(i), pa.int64()), pa.array(count[:len(ids)])])],
                        names=["_id", "nbr_id", "dist2", "compared"])

    # a block meets one group of queries at a time
    met = _own(celled.select("_c", "_cell", "_block", "_id", "_v", "_dist")).join(sizes.select("_c", F.col("_parts").alias("_groups")), "_c")
    met = met.withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    return met.groupBy("_c", "_block", "_group").cogroup(sent.groupBy("_c", "_block", "_group")).applyInArrow(
        compared, f"_id {id_type}, nbr_id {id_type}, dist2 double, compared long")


def _candidates(df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int, checkpoint_input: bool) -> tuple[DataFrame, DataFrame]:
    """(all rows, the k + 1 smallest ids of each class and vector): at equal
    distance ties go to the smaller id, so no further copy is anyone's neighbour.
    The row_number filter is applied in every partition before the shuffle, so a
    huge group of copies never gathers in one task."""
    base = df.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"), F.col(label_col).alias("_c")).where("_c is not null")
    if checkpoint_input:
        base = materialize(base)
    dup = Window.partitionBy("_c", "_v").orderBy("_id")
    return base, materialize(base.withColumn("_dr", F.row_number().over(dup)).where(F.col("_dr") <= k + 1))


def knn_within_class(df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 5,
                     queries: DataFrame | None = None, pivots: int = 64,
                     cell_target: int = 20_000, checkpoint_input: bool = True) -> DataFrame:
    """Exact k nearest same-class neighbours of each query row (self
    excluded, ties by neighbour id): (id, nbr_rank, nbr_id, nbr_vec, dist2).
    ``queries``: optional frame of ids to restrict the left side."""
    base, cand = _candidates(df, id_col, vec_col, label_col, k, checkpoint_input)
    qsel = base if queries is None else base.join(
        queries.select(F.col(queries.columns[0]).alias("_id")).distinct(), "_id", "left_semi")
    # deeper copies: their k nearest are the first k ids of their own group
    deep = qsel.join(cand.select("_id"), "_id", "left_anti")
    firsts = cand.where(F.col("_dr") <= k).select(
        F.col("_c").alias("_fc"), F.col("_v").alias("_fv"), F.col("_id").alias("nbr_id"),
        F.col("_dr").cast("int").alias("nbr_rank"))
    deep_nn = deep.join(firsts, (deep["_c"] == firsts["_fc"]) & (deep["_v"] == firsts["_fv"])).select(
        F.col("_id").alias("id"), "nbr_rank", "nbr_id", F.col("_v").alias("nbr_vec"), F.lit(0.0).alias("dist2"))
    cand = cand.select("_id", "_v", "_c")
    pairs = _pivot_pairs(cand, qsel if queries is not None else cand, k, pivots, cell_target).where("nbr_id is not null")
    w = Window.partitionBy("_id").orderBy("dist2", "nbr_id")
    top = pairs.withColumn("nbr_rank", F.row_number().over(w)).where(F.col("nbr_rank") <= k)
    vectors = cand.select(F.col("_id").alias("nbr_id"), F.col("_v").alias("nbr_vec"))
    top = top.join(vectors, "nbr_id").select(F.col("_id").alias("id"), "nbr_rank", "nbr_id", "nbr_vec", "dist2")
    return top.unionByName(deep_nn)


def pairs_compared(df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 5, pivots: int = 64, cell_target: int = 20_000) -> DataFrame:
    """(n_rows, n_pairs, n_compared): pairs of different vectors' rows within
    classes, and how many of them a search for all neighbours compares."""
    _, cand = _candidates(df, id_col, vec_col, label_col, k, True)
    cand = cand.select("_id", "_v", "_c")
    sizes = cand.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.col("n")).alias("n_pairs")).first()
    done = _pivot_pairs(cand, cand, k, pivots, cell_target).agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("n_compared"))
    return done.select(F.lit(sizes["n_rows"]).cast("long").alias("n_rows"), F.lit(sizes["n_pairs"]).cast("long").alias("n_pairs"), "n_compared")


def smote(df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 5, strict: bool = False,
          chunk: int = 100_000) -> DataFrame:
    """Raise every class to the majority count with synthetic rows
    x + u (n - x), n one of the base row's k same-class neighbours.

    Synthetic row s (1..deficit) of class c is fully determined by hashes of
    (c|s): i = h(c|s, 'pick') mod (n_c k); base = row i div k of the class in
    id order; neighbour rank 1 + i mod k; u = h(c|s, 'gap') / 2^32.
    Classes with n_c <= k use k = n_c - 1 (n_c = 1: copies) unless
    ``strict``.  Returns (label, src, seq, base_id, nbr_id, vec) with
    src in {'orig', 'synth'}; seq is the row id or s.
    """
    rows = materialize(df.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"),
                                 F.col(label_col).alias("_c")))
    id_type = rows.schema["_id"].dataType.simpleString()
    seq_type = "long" if id_type in ("tinyint", "smallint", "int", "bigint") else "string"     # numbers stay numbers
    id_type = "bigint" if seq_type == "long" else id_type
    ranked = rank_within(rows, ["_id"], ["_c"], rank_col="_rk", size_col="_nc")
    sizes = ranked.select("_c", "_nc").distinct()
    # one row per class; the unpartitioned window runs over that table only
    sizes = (sizes.withColumn("_nmax", F.max("_nc").over(Window.partitionBy()))
             .withColumn("_kc", F.least(F.lit(k), F.col("_nc") - 1))
             .withColumn("_d", F.col("_nmax") - F.col("_nc")))
    if strict:
        small = _bounded_collect(sizes.where(F.col("_nc") <= k).select("_c"), 1 << 20)
        if small:
            raise ValueError(f"classes with <= {k} rows: {[r[0] for r in small]}")

    # synthetic ids 1..d, generated in chunks spread over tasks
    ch = (sizes.where(F.col("_d") > 0)
          .select("_c", "_nc", "_kc", "_d",
                  F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_d") / chunk) - 1)).alias("_ch")))
    ch = ch.repartition("_c", "_ch")
    syn = ch.select("_c", "_nc", "_kc", F.explode(F.sequence(F.col("_ch") * chunk + 1,
                                                            F.least(F.col("_d"), (F.col("_ch") + 1) * chunk))).alias("s"))
    key = F.concat(F.col("_c").cast("string"), F.lit("|"), F.col("s").cast("string"))
    modulus = F.when(F.col("_kc") > 0, F.col("_nc") * F.col("_kc")).otherwise(F.col("_nc"))
    syn = (syn.withColumn("_i", hash_key(key, "pick") % modulus)
              .withColumn("_u", hash_key(key, "gap").cast("double") / F.lit(TWO_32))
              .withColumn("_brk", F.when(F.col("_kc") > 0, F.floor(F.col("_i") / F.col("_kc"))).otherwise(F.col("_i")))
              .withColumn("_nr", F.when(F.col("_kc") > 0, F.col("_i") % F.col("_kc") + 1).otherwise(F.lit(0))))
    b = ranked.select(F.col("_c").alias("_cb"), F.col("_rk").alias("_rkb"), F.col("_id").alias("base_id"),
                      F.col("_v").alias("_bv"))
    syn = materialize(syn.join(b, (syn["_c"] == b["_cb"]) & (syn["_brk"] == b["_rkb"])))
    nn = knn_within_class(rows, "_id", "_v", "_c", k, queries=syn.select("base_id"), checkpoint_input=False)
    nn = nn.select(F.col("id").alias("_qid"), F.col("nbr_rank").alias("_qr"), "nbr_id", "nbr_vec")
    syn = syn.join(nn, (syn["base_id"] == nn["_qid"]) & (syn["_nr"] == nn["_qr"]), "left")
    # a class of one row has no neighbour: its copies are the row itself
    lost = F.raise_error(F.concat(F.lit("no neighbour found for row "), F.col("base_id").cast("string"))).cast("array<double>")
    nv = F.coalesce(F.col("nbr_vec"), F.when(F.col("_nr") == 0, F.col("_bv")).otherwise(lost))
    new = F.zip_with(F.col("_bv"), nv, lambda a, n: a + F.col("_u") * (n - a))
    synth = syn.select(F.col("_c").alias(label_col), F.lit("synth").alias("src"), F.col("s").cast(seq_type).alias("seq"),
                       F.col("base_id").cast(id_type).alias("base_id"),
                       F.coalesce(F.col("nbr_id"), F.col("base_id")).cast(id_type).alias("nbr_id"), new.alias(vec_col))
    orig = rows.select(F.col("_c").alias(label_col), F.lit("orig").alias("src"), F.col("_id").cast(seq_type).alias("seq"),
                       F.lit(None).cast(id_type).alias("base_id"), F.lit(None).cast(id_type).alias("nbr_id"),
                       F.col("_v").alias(vec_col))
    return orig.unionByName(synth)
