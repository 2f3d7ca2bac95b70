"""The prefix trie of conversations from padded matrices of turn ids.

A node of depth d is a distinct sequence of first d turns; its members are the
conversations that start with it.  A turn's id is the MD5 of its role and text,
so texts are not shuffled.

The sequences are dealt by range to shards and each shard is worked on by
numpy: rows of turn ids, padded, are ordered by lexsort; a mask of the columns
in which a row differs from the row above it, OR-accumulated from left to
right, marks where the nodes of every depth start; reduceat adds up members,
smallest ids, bytes and leaves over the ranges between the starts, from the
deepest depth up.  Columns come in blocks whose cells are bounded, each with
the rows that reach it only, so one very long conversation widens no other row.

Ordered, the members of a node are neighbours, so the only nodes in more than
one shard are the common prefixes of a shard's last row and the next shard's
first.  What a shard knows of these is additive (a node is counted where it
starts, a leaf where it ends) and is summed by the hash of the prefix: as many
rows as shards times the depth of their boundaries.  Equal conversations,
however many, are cut by their id, and the list of those that end in one node
is hashed as a stream over the shards' pieces.

Defined cases: null ids are no conversations; null roles and texts are empty;
turns are ordered by turn, null first, then by the id of the turn, so repeated
rows are turns of their own; an empty table has no root; texts of any length
count by their UTF-8 bytes; extra columns are not read.  A conversation is one
row here, as a document's text is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import written
from tessera.session import num_partitions

EMPTY = hashlib.sha256(b"").hexdigest()
CELLS = 1 << 21          # of a padded matrix
OUT = ("shard long, depth long, conv_id long, parent_conv_id long, parent_slot long, n_convs long, n_children long, n_leaves long, "
       "saved long, ends string, slot long, key binary, parent_key binary")


def _by_parent(values: np.ndarray, parent: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` over each parent; ``parent`` does not decrease."""
    out = np.zeros(n, np.int64)
    if len(parent):
        at = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        out[parent[at]] = np.add.reduceat(values.astype(np.int64), at)
    return out


def levels(conv: np.ndarray, size: np.ndarray, turns: np.ndarray, nbytes: np.ndarray, cells: int = CELLS) -> list[dict]:
    """Per depth the nodes in order: their first row, members, smallest id,
    bytes of the last text, parent's number, and the rows that end there.
    ``turns`` are ids from 1 on and ``nbytes`` their bytes, row after row."""
    at = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    rows = np.argsort(conv, kind="stable")
    node = np.zeros(len(rows), np.int64)
    ended = size[rows] == 0
    out = [{"first": rows[:1], "n": np.array([len(rows)]), "conv": conv[rows[:1]], "bytes": np.zeros(1, np.int64),
            "parent": np.zeros(0, np.int64), "ends": rows[ended], "ends_of": node[ended], "last": rows[-1:]}]
    rows, node = rows[~ended], node[~ended]
    a = 0
    while len(rows):
        width = int(min((size[rows] - a).max(), max(8, cells // len(rows))))
        col = np.arange(width)
        there = size[rows][:, None] - a > col
        ids = np.zeros(there.shape, np.int64)
        ids[there] = turns[(at[rows][:, None] + a + col)[there]]
        order = np.lexsort([*ids.T[::-1], node])
        rows, node, ids, there = rows[order], node[order], ids[order], there[order]
        changed = np.ones((len(rows), width + 1), bool)
        changed[1:, 0] = node[1:] != node[:-1]
        changed[1:, 1:] = ids[1:] != ids[:-1]
        changed = np.logical_or.accumulate(changed, axis=1)[:, 1:]
        for j in range(width):
            own, depth = np.flatnonzero(there[:, j]), a + j + 1
            starts = np.flatnonzero(changed[own, j])
            members = rows[own]
            parent = node[own[starts]]
            node = np.full(len(rows), -1)
            node[own] = np.cumsum(changed[own, j]) - 1
            ended = own[size[members] == depth]
            ends = rows[ended]
            out.append({"first": members[starts], "n": np.add.reduceat(np.ones(len(own), np.int64), starts),
                        "conv": np.minimum.reduceat(conv[members], starts), "bytes": nbytes[at[members[starts]] + depth - 1],
                        "parent": parent, "ends": ends, "ends_of": node[ended], "last": members[-1:]})
        a += width
        more = size[rows] > a
        rows, node = rows[more], node[more]
    return out


def shard_nodes(conv, size, hi, lo, nbytes, before: int, after: int, cells: int = CELLS):
    """Rows of OUT without the shard.  ``before`` and ``after`` are the turns that
    the shard's first and last rows share with their neighbours in the shards
    beside it; -1: there is none."""
    order = np.lexsort([lo, hi])
    turns = np.empty(len(hi), np.int64)
    turns[order] = np.cumsum(np.concatenate(([True], (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])))[:len(hi)])
    at = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    trie = levels(conv, size, turns, nbytes, cells)
    leaves = saved = parent = np.zeros(0, np.int64)
    for depth in range(len(trie) - 1, -1, -1):
        own = trie[depth]
        n = len(own["n"])
        inside = np.bincount(parent, minlength=n)
        begun = np.ones(len(parent), np.int64)
        begun[:1] -= depth + 1 <= before                      # counted by the shard where it starts
        own["children"] = _by_parent(begun, parent, n)
        leaf = (inside == 0).astype(np.int64)
        new = np.ones(n, np.int64)
        if depth <= after:
            leaf[-1] = 0                                       # counted by the shard where it ends
        if depth <= before:
            new[0] = 0
        own["leaves"] = leaf + _by_parent(leaves, parent, n)
        own["saved"] = (own["n"] - new) * own["bytes"] + _by_parent(saved, parent, n)
        leaves, saved, parent = own["leaves"], own["saved"], own["parent"]

    def path(row: int, depth: int) -> list[bytes]:
        """Hashes of a row's first 0, 1, ... turns."""
        h, out = hashlib.blake2b(digest_size=16), []
        ids = np.stack((hi[at[row]:at[row] + depth], lo[at[row]:at[row] + depth]), axis=1).astype(">u8").tobytes()
        for d in range(depth + 1):
            out.append(d.to_bytes(8, "big") + h.copy().digest())
            h.update(ids[16 * d:16 * d + 16])
        return out

    heads = path(int(trie[before]["first"][0]), before) if before >= 0 else []
    tails = path(int(trie[after]["last"][0]), after) if after >= 0 else []
    for depth, own in enumerate(trie):
        n = len(own["n"])
        lists = np.split(conv[own["ends"]], np.searchsorted(own["ends_of"], np.arange(1, n))) if len(own["ends"]) else [()] * n
        above = trie[depth - 1] if depth else None
        for i in range(n):
            text = ",".join(map(str, lists[i].tolist())) if len(lists[i]) else ""
            slot, key = (2 * depth, heads[depth]) if i == 0 and depth <= before else (2 * depth + 1, tails[depth]) if i == n - 1 and depth <= after else (None, None)
            up = slot_up = key_up = None
            if depth:
                p = int(own["parent"][i])
                up = int(above["conv"][p])
                if p == 0 and depth - 1 <= before:
                    up, slot_up, key_up = None, 2 * depth - 2, heads[depth - 1]
                elif p == len(above["n"]) - 1 and depth - 1 <= after:
                    up, slot_up, key_up = None, 2 * depth - 1, tails[depth - 1]
            if key is None:
                text = hashlib.sha256(text.encode()).hexdigest() if text else EMPTY
            yield (depth, int(own["conv"][i]), up, slot_up, int(own["n"][i]), int(own["children"][i]), int(own["leaves"][i]),
                   int(own["saved"][i]), text, slot, key, key_up)


def sequences(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
              group: Column | None = None) -> DataFrame:
    """(c, g, seq): every conversation's turns in order, (turn, id, nbytes); ``g``
    is ``group`` over the column c (by default c), and rows are dealt by it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = (df.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), F.unhex(F.md5(F.concat_ws(
        ":", F.octet_length(role).cast("string"), F.concat(role, text)))).alias("id"), F.octet_length(text).alias("nbytes"))
        .where("c is not null").withColumn("g", F.col("c") if group is None else group).repartition("g"))
    return turns.groupBy("g", "c").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "nbytes"))).alias("seq"))


def rebuilt(seqs: DataFrame, head: Column, most: int) -> DataFrame:
    """Each conversation after its first ``head`` turns (an expression over c, at
    most ``most``), which are those of the conversation whose id is its group's."""
    base = F.max(F.when(F.col("c") == F.col("g"), F.slice("seq", 1, most))).over(Window.partitionBy("g"))
    both = seqs.withColumn("base", base).withColumn("h", head.cast("int"))
    first = F.when(F.col("base").isNull(), F.slice("seq", 1, 0)).otherwise(F.slice("base", F.lit(1), F.col("h")))
    return both.select("c", F.concat(first, F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))).alias("seq"))


def nodes(seqs: DataFrame, shard_turns: int = 200_000) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 of every node of the trie of (c, seq)."""
    spark = seqs.sparkSession
    flat = written(seqs.select("c", F.col("seq.id").alias("ids"), F.col("seq.nbytes").alias("nbytes")), "sequences")
    total = flat.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    shards = max(num_partitions(spark), -(-total // shard_turns))
    dealt = written(flat.repartitionByRange(shards, "ids", "c").withColumn("shard", F.spark_partition_id().cast("long")), "shards")
    edges = dealt.groupBy("shard").agg(F.min(F.struct("ids", "c")).alias("lo"), F.max(F.struct("ids", "c")).alias("hi"))
    by = Window.orderBy("shard")                               # a row per shard

    def shared(a: Column, b: Column) -> Column:
        at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
        return F.when(a.isNull() | b.isNull(), -1).when(at == 0, F.size(a)).otherwise(at - 1).cast("long")

    edges = edges.select("shard", shared(F.col("lo.ids"), F.lag("hi.ids").over(by)).alias("before"), shared(F.col("hi.ids"), F.lead("lo.ids").over(by)).alias("after"))

    def work(table: pa.Table) -> pa.Table:
        shard, before, after = (table.column(c)[0].as_py() for c in ("shard", "before", "after"))
        ids, nbytes = table.column("ids").combine_chunks(), table.column("nbytes").combine_chunks()
        size = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.frombuffer(b"".join(ids.flatten().to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
        got = shard_nodes(table.column("c").to_numpy(), size, raw[:, 0], raw[:, 1], nbytes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), before, after)
        names, kinds = zip(*(x.split() for x in OUT.split(", ")))
        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k] for k in kinds]
        cols = list(zip(*got))
        return pa.table([pa.array([shard] * len(cols[0]), pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds[1:])]], names=list(names))

    parts = written(dealt.join(edges, "shard").groupBy("shard").applyInArrow(work, OUT), "nodes")
    common = parts.where("key is not null")
    sums = written(common.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *[
        F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]), "common")

    def streamed(batches):
        now, h = None, None
        for batch in batches:
            done = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("ends")):
                if key != now:
                    if h is not None:
                        done.append((now, h.hexdigest()))
                    now, h = key, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(text.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "ends"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends"])

    ends = (common.where("ends != ''").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
            .select("key", "ends").mapInArrow(streamed, "key binary, ends string"))
    above = sums.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    boundary = (sums.join(ends, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(EMPTY))).join(above, "parent_key", "left").select(*cols))
    inner = parts.where("key is null")
    slots = common.select("shard", F.col("slot").alias("parent_slot"), "key").join(sums.select("key", F.col("conv_id").alias("up")), "key").drop("key")
    under = (inner.where("parent_slot is not null").join(slots, ["shard", "parent_slot"]).withColumn("parent_conv_id", F.col("up")).select(*cols))
    return inner.where("parent_slot is null").select(*cols).unionByName(under).unionByName(boundary)
