"""Random forests whose trees never lie in the driver.

Spark ML grows a forest by levels: every task holds statistics of 64 bins for
each node and ships them, and the driver holds all nodes.  A forest of depth 30
has about as many nodes as trees times rows, most of them with a handful of rows.
``Forest`` is Spark ML's ``RandomForestClassifier`` up to ``DRIVER_ROWS`` rows times
trees.  Above, it grows the same kind of forest (bootstrap weights, split points from
a sample, a random subset of the features at each node, Gini impurity, equal leaves
merged) in another place: a node of more than ``local_rows`` rows is split by
statistics added up over the tasks, as Spark ML does, and every smaller one goes
with its rows (a byte for a value) to one task, which grows all below it.  The driver
holds the few nodes above, the split points and an importance for each feature.
The trees are a table, a row for each part that a task grew; ``WideForestModel``
joins it with the rows to score, both dealt into bounded parts.
"""

from __future__ import annotations

import json
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialize, num_partitions, scratch_path, ship_package

DRIVER_ROWS = 250_000        # rows times trees of a forest that the driver holds
LOCAL_ROWS = 1 << 18         # rows of a node that one task finishes, at most
LOCAL_BYTES = 64 << 20       # and their bytes
BLOCK_BYTES = 4 << 20        # of a block of rows
CELLS = 1 << 20              # numbers of a table of statistics
PASS_NODES = 1024            # nodes split in a pass over the rows
BUNDLE_NODES = 500_000       # nodes of trees that meet rows in one task
PART_ROWS = 100_000          # rows to score in one task
PADS = (4, 8, 16, 32, 64)    # rows of small nodes, sorted instead of counted by bin
_LEAST_GAIN = 1e-14
TREES = "tree int, root long, feature array<int>, bin array<int>, child array<int>, counts array<double>, importance array<double>"


# ---------------------------------------------------------------- one node
def _best(left: np.ndarray, valid: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, gain, left counts) of the best split of every node.  ``left``:
    class counts at or below each place, (nodes, features, places, classes)."""
    right = total[:, None, None] - left
    lw, rw = left.sum(-1), right.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left * left).sum(-1) / lw + (right * right).sum(-1) / rw
    score[~(valid & (lw > 0) & (rw > 0))] = -np.inf
    flat = score.reshape(len(total), -1)
    at = flat.argmax(1)
    each, weight = np.arange(len(total)), total.sum(1)
    gain = (flat[each, at] - (total * total).sum(1) / weight) / weight
    return at, gain, left.reshape(len(total), -1, total.shape[1])[each, at]


def _counted(stats: np.ndarray, total: np.ndarray):
    """The best split by statistics of (nodes, features, bins, classes): (feature's place, bin, gain, left counts)."""
    left = stats.cumsum(2)[:, :, :-1]
    at, gain, got = _best(left, np.ones(left.shape[:3], bool), total)
    return at // left.shape[2], at % left.shape[2], gain, got


def _subsets(rng: np.random.Generator, nodes: int, width: int, few: int) -> np.ndarray:
    return np.tile(np.arange(width), (nodes, 1)) if few >= width else rng.random((nodes, width)).argpartition(few - 1, 1)[:, :few]


def _statistics(x, y, w, node, subsets, bins, classes) -> np.ndarray:
    """Class counts by node, feature of its subset and bin."""
    few = subsets.shape[1]
    values = x[np.arange(len(x))[:, None], subsets[node]].astype(np.int64)
    key = ((node[:, None] * few + np.arange(few)) * bins + values) * classes + y[:, None]
    return np.bincount(key.ravel(), np.repeat(w, few), len(subsets) * few * bins * classes).reshape(len(subsets), few, bins, classes)


def _split_small(x, y, w, rows, size, subsets, total):
    """The best split of nodes of few rows: ``rows`` (nodes, pad) has their first ``size`` rows, which are sorted by value."""
    pad, here = rows.shape[1], np.arange(rows.shape[1]) < size[:, None]
    code = (x[rows[:, None, :], subsets[:, :, None]].astype(np.uint32) << 8) | np.arange(pad, dtype=np.uint32)
    code = np.sort(np.where(here[:, None], code, 1 << 20), axis=2)
    bin_, at = code >> 8, (code & 0xFF).astype(np.intp)
    one = np.zeros((*rows.shape, total.shape[1]))
    np.put_along_axis(one, y[rows][..., None], (w[rows] * here)[..., None], 2)
    left = one[np.arange(len(rows))[:, None, None], at].cumsum(2)[:, :, :-1]
    place, gain, got = _best(left, (bin_[:, :, :-1] != bin_[:, :, 1:]) & (bin_[:, :, 1:] < 1 << 12), total)
    slot, p = place // (pad - 1), place % (pad - 1)
    return slot, bin_[np.arange(len(rows)), slot, p].astype(np.int64), gain, got


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, bins: int, few: int, depth: int, rng: np.random.Generator) -> dict:
    """All below one node, by levels.  ``x``: bins (rows, features), ``y``: classes,
    ``w``: weights.  Arrays by node: ``feature`` (-1: a leaf), ``bin`` (rows at or
    below go left), ``child`` (the left child, the right one follows it; of a leaf
    its place in ``counts``); ``importance``: gain times weight by feature."""
    w = w.astype(np.float64)
    order, start = np.arange(len(x)), np.array([0, len(x)])
    total = np.bincount(y, w, classes)[None]
    levels = []
    for level in range(depth + 1):
        n = len(total)
        feature, split, gains, lefts = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros_like(total)
        size = np.diff(start)
        mixed = np.flatnonzero(((total > 0).sum(1) > 1) & (level < depth))
        lower = 0
        for pad in (*PADS, None):
            some = mixed[(size[mixed] > lower) & (size[mixed] <= (pad or len(x)))]
            lower = pad
            each = max(1, CELLS // max(few * (pad or bins) * classes, x.shape[1]))
            for a in range(0, len(some), each):
                g = some[a:a + each]
                subsets = _subsets(rng, len(g), x.shape[1], few)
                if pad:
                    rows = order[np.minimum(start[g][:, None] + np.arange(pad), len(order) - 1)]
                    slot, b, gain, got = _split_small(x, y, w, rows, size[g], subsets, total[g])
                else:
                    node = np.repeat(np.arange(len(g)), size[g])
                    rows = order[np.arange(len(node)) + np.repeat(start[g] - np.concatenate(([0], np.cumsum(size[g])[:-1])), size[g])]
                    slot, b, gain, got = _counted(_statistics(x[rows], y[rows], w[rows], node, subsets, bins, classes), total[g])
                good = gain > _LEAST_GAIN
                feature[g[good]], split[g[good]] = subsets[np.flatnonzero(good), slot[good]], b[good]
                gains[g[good]], lefts[g[good]] = gain[good], got[good]
        levels.append((feature, split, gains, total))
        parents = np.flatnonzero(feature >= 0)
        if not len(parents):
            break
        of = np.repeat(np.arange(n), size)
        stays = feature[of] >= 0
        order, of = order[stays], of[stays]
        place = np.zeros(n, np.int64)
        place[parents] = np.arange(len(parents))
        to = 2 * place[of] + (x[order, feature[of]] > split[of])
        order = order[np.argsort(to, kind="stable")]
        start = np.concatenate(([0], np.cumsum(np.bincount(to, minlength=2 * len(parents)))))
        total = np.stack([lefts[parents], total[parents] - lefts[parents]], 1).reshape(-1, classes)
    return _merged(levels, x.shape[1])


def _merged(levels: list, width: int) -> dict:
    """The levels as one tree, without splits into two leaves of one class."""
    inner, leaf = [f >= 0 for f, *_ in levels], [f < 0 for f, *_ in levels]
    for k in range(len(levels) - 2, -1, -1):
        parents, says = np.flatnonzero(inner[k]), levels[k + 1][3].argmax(1)
        leaf[k][parents] = leaf[k + 1][::2] & leaf[k + 1][1::2] & (says[::2] == says[1::2])
    importance, parts, kept, at, leaves = np.zeros(width), [], np.ones(1, bool), 0, 0
    for k, (feature, split, gains, total) in enumerate(levels):
        goes = kept & ~leaf[k]                      # nodes that stay split
        np.add.at(importance, feature[goes], gains[goes] * total[goes].sum(1))
        child = np.zeros(len(feature), np.int64)
        at += int(kept.sum())
        child[goes] = at + 2 * np.arange(goes.sum())
        ends = kept & leaf[k]
        child[ends] = leaves + np.arange(ends.sum())
        leaves += int(ends.sum())
        parts.append((np.where(goes, feature, -1)[kept], split[kept], child[kept], total[ends]))
        kept = np.repeat(goes[inner[k]], 2)
    feature, split, child, counts = (np.concatenate(p) for p in zip(*parts))
    return {"feature": feature, "bin": split, "child": child, "counts": counts, "importance": importance}


# ------------------------------------------------------------ rows as bytes
def split_points(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 split points of a feature, in equal steps of its
    sample, half-way between two values (as Spark ML chooses them)."""
    v, n = np.unique(values[~np.isnan(values)], return_counts=True)
    between = (v[:-1] + v[1:]) / 2
    if len(between) < bins:
        return between
    stride, seen, target, out = len(values) / bins, int(n[0]), len(values) / bins, []
    for k in range(1, len(v)):
        before, seen = seen, seen + int(n[k])
        if abs(before - target) < abs(seen - target):
            out.append(between[k - 1])
            target += stride
    return np.array(out)


def _to_bins(values: pa.ListArray | pa.ChunkedArray, points: list) -> np.ndarray:
    lists = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(points))
    return np.stack([np.searchsorted(p, x[:, j], "left") for j, p in enumerate(points)], 1).astype(np.uint8)


def _blocks(points: list, key: str):
    """Batches of (key, x) as blocks: the keys and the bins of some rows as bytes."""
    def run(batches):
        most = max(1, BLOCK_BYTES // max(1, len(points)))
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                keys = part.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([_to_bins(part.column("x"), points).tobytes()], pa.binary())],
                                                 names=["keys", "bins"])
    return run


def _unblocked(table, width: int) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.frombuffer(b, np.int64) for b in table.column("keys").to_pylist()]
    x = [np.frombuffer(b, np.uint8).reshape(-1, width) for b in table.column("bins").to_pylist()]
    return np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros((0, width), np.uint8), *x])


def _descend(x: np.ndarray, top: dict, tree: int) -> np.ndarray:
    """The node, numbered like a heap from 1, that every row reaches in the upper part of a tree."""
    node = np.ones(len(x), np.int64)
    if tree in top:
        ids, feature, split = top[tree]
        while True:
            at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
            on = np.flatnonzero(ids[at] == node)
            if not len(on):
                break
            node[on] = 2 * node[on] + (x[on, feature[at[on]]] > split[at[on]])
    return node


def _arrays(top: dict) -> dict:
    """tree -> {node: (feature, bin, ...)} as sorted arrays."""
    out = {}
    for tree, nodes in top.items():
        ids = np.array(sorted(nodes), np.int64)
        out[tree] = (ids, np.array([nodes[i][0] for i in ids], np.int64), np.array([nodes[i][1] for i in ids], np.int64))
    return out


def _weights(seed: int, trees: int):
    """Bootstrap weights of one block of rows after another of this task; one tree alone gets all rows once."""
    context = TaskContext.get()
    rng = np.random.default_rng([seed, context.partitionId() if context else 0])
    return lambda n: rng.poisson(1.0, (n, trees)) if trees > 1 else np.ones((n, 1), np.int64)


def _node_rng(seed: int, tree: int, node: int) -> np.random.Generator:
    return np.random.default_rng([seed, tree, node, 1])


# ------------------------------------------------------------------ the fit
def fit_wide(df: DataFrame, features: str, label: str, trees: int, depth: int, bins: int, few, seed: int, local_rows: int | None = None) -> dict:
    """The state of a ``WideForestModel``; ``few(width)``: the features that a node looks at."""
    spark = df.sparkSession
    ship_package(spark)
    if bins > 256:
        raise ValueError("more than 256 bins")
    seed = seed % (1 << 63)
    rows = df.select(F.col(label).cast("long").alias("y"), vector_to_array(F.col(features)).alias("x"))
    n, most, width = rows.agg(F.count(F.lit(1)), F.max("y"), F.max(F.size("x"))).first()
    classes, few = int(most) + 1, few(width)
    local_rows = local_rows or max(1000, min(LOCAL_ROWS, LOCAL_BYTES // width))

    sampled = rows if n <= max(bins * bins, 10_000) else rows.sample(max(bins * bins, 10_000) / n, seed)

    def points_of(table: pa.Table) -> pa.Table:
        got = split_points(table.column("v").to_numpy(), bins)
        return pa.table({"j": table.column("j")[:1], "points": pa.array([got], pa.list_(pa.float64()))})

    found = sampled.select(F.posexplode("x").alias("j", "v")).groupBy("j").applyInArrow(points_of, "j int, points array<double>").collect()  # a row per feature
    points = [np.array(p) for _, p in sorted((r["j"], r["points"]) for r in found)]
    blocks = materialize(rows.mapInArrow(_blocks(points, "y"), "keys binary, bins binary"))

    # the upper nodes: split ones, large ones to split, large leaves with their class counts
    top, large, ends = {}, [(t, 1) for t in range(trees)] if n > local_rows and depth else [], {}
    while large:
        now, large = large[:PASS_NODES], large[PASS_NODES:]
        for r in _split_large(blocks, _arrays(top), now, trees, width, classes, bins, few, seed).collect():        # a row per node
            tree, node, below, total = r["tree"], r["node"], np.array(r["below"]), np.array(r["total"])
            if r["gain"] <= _LEAST_GAIN:
                ends[tree, node] = total
                continue
            top.setdefault(tree, {})[node] = (r["feature"], r["bin"], r["gain"], total)
            for child, counts in ((2 * node, below), (2 * node + 1, total - below)):
                if counts.sum() > local_rows and child.bit_length() <= depth:
                    large.append((tree, child))
                elif counts.sum() > local_rows:
                    ends[tree, child] = counts
    store = scratch_path(spark, "forest")
    _grown(blocks, _arrays(top), set(ends), trees, width, classes, bins, few, depth, seed).write.parquet(store)
    ends = _merge_top(spark, store, top, ends)
    if ends:
        leaves = [(tree, node, [-1], [0], [0], counts.tolist(), []) for (tree, node), counts in ends.items()]
        spark.createDataFrame(leaves, TREES).write.mode("append").parquet(store)
    each = spark.read.parquet(store).select("tree", F.posexplode("importance").alias("j", "v")).groupBy("tree", "j").agg(F.sum("v").alias("v"))
    nodes = spark.read.parquet(store).agg(F.sum(F.size("feature"))).first()[0]
    by_tree = np.zeros((trees, width))
    for r in each.collect():                        # a row per tree and feature
        by_tree[r["tree"], r["j"]] = r["v"]
    for tree, upper in top.items():
        for feature, _, gain, total in upper.values():
            by_tree[tree, feature] += gain * sum(total)
    sums = by_tree.sum(1, keepdims=True)
    importance = np.divide(by_tree, sums, out=np.zeros_like(by_tree), where=sums > 0).sum(0)
    return {"trees": trees, "classes": classes, "nodes": int(nodes), "points": [p.tolist() for p in points], "store": store,
            "importances": (importance / (importance.sum() or 1.0)).tolist(),
            "top": {t: [a.tolist() for a in arrays] for t, arrays in _arrays(top).items()}}


def _split_large(blocks, top, large, trees, width, classes, bins, few, seed) -> DataFrame:
    """(tree, node, feature, bin, gain, below, total) of the best split of the ``large`` nodes, by statistics of all tasks."""
    wanted: dict = {}
    for tree, node in large:
        wanted.setdefault(tree, []).append(node)
    subset = {k: _subsets(_node_rng(seed, *k), 1, width, few) for k in large}

    def counted(batches):
        draw, sums = _weights(seed, trees), {}
        for batch in batches:
            for b in range(batch.num_rows):
                y, x = _unblocked(batch.slice(b, 1), width)
                weights = draw(len(y))
                for tree, nodes in wanted.items():
                    at = _descend(x, top, tree)
                    for node in nodes:
                        i = np.flatnonzero((at == node) & (weights[:, tree] > 0))
                        got = _statistics(x[i], y[i], weights[i, tree].astype(np.float64), np.zeros(len(i), np.int64), subset[tree, node], bins, classes)
                        sums[tree, node] = sums.get((tree, node), 0) + got
        for (tree, node), s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([node], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["tree", "node", "stats"])

    def chosen(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        stats = sum(np.frombuffer(b, np.float64) for b in table.column("stats").to_pylist()).reshape(1, -1, bins, classes)
        total = stats[0, 0].sum(0)
        slot, b, gain, below = _counted(stats, total[None])
        return pa.table([pa.array([v], t) for v, t in ((tree, pa.int32()), (node, pa.int64()), (int(subset[tree, node][0, slot[0]]), pa.int32()), (int(b[0]), pa.int32()),
                                                       (float(gain[0]), pa.float64()), (below[0].tolist(), pa.list_(pa.float64())), (total.tolist(), pa.list_(pa.float64())))],
                        names=["tree", "node", "feature", "bin", "gain", "below", "total"])

    stats = blocks.mapInArrow(counted, "tree int, node long, stats binary")
    return stats.groupBy("tree", "node").applyInArrow(chosen, "tree int, node long, feature int, bin int, gain double, below array<double>, total array<double>")


def _grown(blocks, top, ends, trees, width, classes, bins, few, depth, seed) -> DataFrame:
    """A row for each node below the upper ones: all below it, grown by one task."""
    def dealt(batches):
        draw = _weights(seed, trees)
        for batch in batches:
            for b in range(batch.num_rows):
                y, x = _unblocked(batch.slice(b, 1), width)
                weights = draw(len(y))
                for tree in range(trees):
                    at = np.where(weights[:, tree] > 0, _descend(x, top, tree), 0)
                    for root in (r for r in np.unique(at[at > 0]) if (tree, r) not in ends):
                        i = np.flatnonzero(at == root)
                        yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([root], pa.int64()),
                                                          pa.array([(y[i] * (1 << 20) + weights[i, tree]).astype(np.int64).tobytes()], pa.binary()),
                                                          pa.array([x[i].tobytes()], pa.binary())], names=["tree", "root", "keys", "bins"])

    def grown(table: pa.Table) -> pa.Table:
        tree, root = table.column("tree")[0].as_py(), table.column("root")[0].as_py()
        keys, x = _unblocked(table, width)
        got = grow(x, keys >> 20, keys & ((1 << 20) - 1), classes, bins, few, depth + 1 - root.bit_length(), _node_rng(seed, tree, root))
        return pa.table([pa.array([tree], pa.int32()), pa.array([root], pa.int64()), *[pa.array([got[k].astype(np.int32)], pa.list_(pa.int32())) for k in ("feature", "bin", "child")],
                         pa.array([got["counts"].ravel()], pa.list_(pa.float64())), pa.array([got["importance"]], pa.list_(pa.float64()))],
                        names=["tree", "root", "feature", "bin", "child", "counts", "importance"])

    parts = blocks.mapInArrow(dealt, "tree int, root long, keys binary, bins binary")
    return parts.repartition(max(trees, num_partitions(blocks.sparkSession)), "tree", "root").groupBy("tree", "root").applyInArrow(grown, TREES)


def _merge_top(spark, store: str, top: dict, ends: dict) -> dict:
    """Takes upper splits into two leaves of one class out of ``top``; ``ends`` with the leaves that come in their place."""
    alone = spark.read.parquet(store).where(F.size("feature") == 1).select("tree", "root", "counts") if top else None
    leaves = ends | ({(r["tree"], r["root"]): np.array(r["counts"]) for r in alone.collect()} if top else {})       # a row per part at most
    ends = dict(ends)
    for tree, upper in list(top.items()):
        for node in sorted(upper, reverse=True):
            a, b = leaves.get((tree, 2 * node)), leaves.get((tree, 2 * node + 1))
            if a is not None and b is not None and a.argmax() == b.argmax():
                leaves[tree, node] = ends[tree, node] = upper.pop(node)[3]
                for child in (2 * node, 2 * node + 1):          # one that a task grew stays, out of reach
                    ends.pop((tree, child), None)
        if not upper:
            del top[tree]
    return ends


# ---------------------------------------------------------------- the model
class Forest(RandomForestClassifier):
    """Spark ML's random forest; one too large for the driver is a ``WideForestModel``."""

    def _fit(self, dataset: DataFrame):
        trees = self.getNumTrees()
        if dataset.count() * trees <= DRIVER_ROWS:
            return super()._fit(dataset)
        if self.getFeatureSubsetStrategy() != "sqrt" or self.getImpurity() != "gini":
            raise ValueError("a forest of this size has subsets of sqrt features and Gini impurity")
        state = fit_wide(dataset, self.getFeaturesCol(), self.getLabelCol(), trees, self.getMaxDepth(), self.getMaxBins(),
                         lambda width: int(np.ceil(np.sqrt(width))), self.getSeed())
        return WideForestModel(state)._set(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol())


class WideForestModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, MLWritable, MLReadable):
    """A forest whose trees are a table (``state["store"]``)."""

    def __init__(self, state: dict | None = None):
        super().__init__()
        self.state = state or {}

    @property
    def featureImportances(self):
        """By feature: its share of a tree's gains, averaged over the trees."""
        return Vectors.dense(self.state["importances"])

    @cached_property
    def _top(self) -> dict:
        return {int(t): tuple(np.array(a, np.int64) for a in arrays) for t, arrays in self.state["top"].items()}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s, spark, top = self.state, dataset.sparkSession, self._top
        ship_package(spark)
        points, classes = [np.array(p) for p in s["points"]], s["classes"]
        rows = materialize(dataset.withColumn("_row", F.monotonically_increasing_id()))
        bundles, parts = -(-s["nodes"] // BUNDLE_NODES), max(1, -(-rows.count() // PART_ROWS))
        cells = min(bundles * parts, num_partitions(spark))

        def votes(asked: pa.Table, trees: pa.Table) -> pa.Table:
            """The sum of the trees' votes for every row, a tree after the other in their order."""
            ids, x = _unblocked(asked, len(points))
            out = np.zeros((len(ids), classes))
            order = sorted(range(trees.num_rows), key=lambda i: (trees.column("tree")[i].as_py(), trees.column("root")[i].as_py()))
            reached, last = None, None
            for i in order:
                tree, root = trees.column("tree")[i].as_py(), trees.column("root")[i].as_py()
                if tree != last:
                    reached, last = _descend(x, top, tree), tree
                feature, split, child = (np.asarray(trees.column(c)[i].values) for c in ("feature", "bin", "child"))
                counts = np.asarray(trees.column("counts")[i].values).reshape(-1, classes)
                on = np.flatnonzero(reached == root)
                at, going = np.zeros(len(on), np.int64), np.arange(len(on))
                while len(going := going[feature[at[going]] >= 0]):
                    here = at[going]
                    at[going] = child[here] + (x[on[going], feature[here]] > split[here])
                out[on] += (counts / counts.sum(1, keepdims=True))[child[at]]
            each = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), classes).cast(pa.list_(pa.float64()))
            bundle = (asked if asked.num_rows else trees).column("_bundle")[0]
            return pa.table([pa.array(ids), pa.array([bundle.as_py()] * len(ids), pa.int32()), each], names=["_row", "_bundle", "votes"])

        blocks = rows.select("_row", vector_to_array(F.col(self.getFeaturesCol())).alias("x")).mapInArrow(_blocks(points, "_row"), "keys binary, bins binary")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asked = blocks.withColumn("_part", F.pmod(F.xxhash64("keys"), F.lit(parts)).cast("int")).withColumn("_bundle", each(bundles))
        trees = spark.read.parquet(s["store"]).drop("importance").withColumn("_bundle", F.pmod(F.xxhash64("tree", "root"), F.lit(bundles)).cast("int")).withColumn("_part", each(parts))
        deal = lambda df: df.repartition(cells, "_bundle", "_part").groupBy("_bundle", "_part")
        got = deal(asked).cogroup(deal(trees)).applyInArrow(votes, "_row long, _bundle int, votes array<double>")
        got = got.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_bundle", "votes"))).alias("all"))
        start = F.array(*[F.lit(0.0)] * classes)
        got = got.select("_row", F.aggregate("all", start, lambda a, b: F.zip_with(a, b["votes"], lambda u, v: u + v)).alias("_raw"))
        out = rows.join(got, "_row")
        weight = F.aggregate("_raw", F.lit(0.0), lambda a, v: a + v)
        return (out.withColumn("rawPrediction", array_to_vector("_raw"))
                .withColumn("probability", array_to_vector(F.transform("_raw", lambda v: v / weight)))
                .withColumn(self.getPredictionCol(), (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double")).drop("_row", "_raw"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: WideForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark, {"forest": json.dumps({k: v for k, v in self.model.state.items() if k != "store"})})
        spark.read.parquet(self.model.state["store"]).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> WideForestModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = WideForestModel(json.loads(metadata["forest"]) | {"store": f"{path}/trees"})
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def load_model(path: str):
    """The model saved at ``path``, of either kind."""
    return DefaultParamsReader.loadParamsInstance(path, SparkSession.getActiveSession())
