"""Mixing sources to target weights by hierarchical budgeting.

The rows form a tree: domains, languages of a domain, sources of a language
(any list of columns).  Each node has an integer weight among its siblings.
The token budget goes down from the root.  At each level it is split in
proportion to the weights; a node that cannot use its share, because its
leaves hold fewer tokens times ``epochs``, is filled up, and what it leaves
goes to its siblings in proportion to their weights, again and again until
none is overfull.  A parent's capacity is the sum of its leaves', so a
shortage leaves a parent for that parent's siblings only when all its
children are full.  In closed form: among siblings sorted by capacity over
weight, a prefix is full and the others share the rest.

A leaf reads its rows in epochs; in each epoch the rows have another seeded
order (md5 of seed, epoch and id; ties by id, then by the row's text digest).
It takes the longest prefix, over all epochs, whose tokens fit its budget.
No order of a whole leaf is sorted in one task: rows are counted by leaf,
epoch and the first ``bucket_bits`` bits of their order hash (summed before
the shuffle), the running sums of these buckets tell which are taken whole,
and only the one bucket per leaf in which the budget ends is put in order.

DataFrame functions only.  All quantities are 64-bit integers, so that SQL
reproduces every row.

Defined cases: null text has no tokens; a row of no tokens is taken if its
place lies within the prefix; null in a tree column is a node of its own; a
weight that is not given is 1, a weight of 0 takes nothing; rows with equal
order (repeated rows) are interchangeable and told apart by their text; a
budget beyond the capacity takes everything, every epoch; an empty table
gives an empty result; extra columns pass through, and only the operator's
own columns (epoch, n_tokens) replace clashing ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import row_struct
from tessera.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
NULL_NODE = "\u2400null"
HASH_BITS = 32
BROADCAST_LEAVES = 50_000        # rows of about 100 bytes; more leaves are joined by a shuffle


def n_tokens(text: Column) -> Column:
    """Words of the whole text, a tokeniser-free count of its tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def order_hash(row_id: Column, epoch: Column, seed: int) -> Column:
    """The first 32 bits of md5('id:seed:epoch') as a long."""
    key = F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(f":{seed}:"), epoch.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]],
            budget: Column, epochs: int) -> DataFrame:
    """leaves: ``levels`` and ``tokens``.  Adds ``budget`` to each leaf.
    The argument ``budget`` is a column that may use ``tokens``, the total."""
    tree = leaves.withColumn("capacity", F.col("tokens") * F.lit(epochs))
    above = None
    done: list[str] = []
    for level in levels:
        weight = F.lit(1)
        for name, w in weights.get(level, {}).items():
            weight = F.when(F.col(level) == name, F.lit(int(w))).otherwise(weight)
        inside = Window.partitionBy(*done)                        # the root's children: a handful of rows
        nodes = (tree.groupBy(*done, level)
                 .agg(F.sum("tokens").cast("long").alias("tokens"), F.sum("capacity").cast("long").alias("capacity"))
                 .withColumn("w", weight.cast("long")))
        if above is None:
            nodes = (nodes.withColumn("tokens", F.sum("tokens").over(inside))
                     .withColumn("parent_budget", budget.cast("long")))
        else:
            nodes = nodes.join(above, done)
        nodes = nodes.withColumn("capacity", F.when(F.col("w") == 0, F.lit(0)).otherwise(F.col("capacity")))
        order = inside.orderBy(F.col("capacity") / F.greatest(F.col("w"), F.lit(1)), F.col(level))
        rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        nodes = (nodes.withColumn("w_rest", F.greatest(F.sum("w").over(rest), F.lit(1)))
                 .withColumn("left", F.greatest(F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)), F.lit(0)))
                 # full: an even share of what the fuller siblings leave covers the capacity
                 .withColumn("full", F.expr("left div w_rest") * F.col("w") >= F.col("capacity"))
                 .withColumn("full_capacity", F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(inside))
                 .withColumn("open_w", F.greatest(F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(inside), F.lit(1))))
        share = F.expr("greatest(parent_budget - full_capacity, 0) div open_w") * F.col("w")
        above = nodes.select(*done, level, F.when(F.col("full"), F.col("capacity"))
                             .otherwise(F.least(share, F.col("capacity"))).alias("parent_budget"))
        done.append(level)
    return leaves.join(above.withColumnRenamed("parent_budget", "budget"), list(levels))


def mix(df: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: Column | int,
        epochs: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
        bucket_bits: int = 12) -> DataFrame:
    """The taken rows of ``df`` with ``epoch`` (from 0) and ``n_tokens``.
    ``weights``: per level column, node name to integer weight.  ``budget``:
    tokens in all, a number or a column over the total ``tokens``."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    keys = [f"__level{i}" for i in range(len(levels))]
    by_key = {k: weights.get(name, {}) for k, name in zip(keys, levels)}
    named = {k: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(NULL_NODE)) for k, name in zip(keys, levels)}
    rows = (df.select(row_struct(df, ("epoch", "n_tokens")).alias("__row"), F.col(id_col).alias("__id"), n_tokens(F.col(text_col)).alias("__tokens"),
                      *[c.alias(k) for k, c in named.items()])
            .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
            .withColumn("__h", order_hash(F.col("__id"), F.col("epoch"), seed))
            .withColumn("__bucket", F.shiftright("__h", HASH_BITS - bucket_bits).cast("long")))
    narrow = rows.select(*keys, "epoch", "__bucket", "__tokens")
    sums = narrow.groupBy(*keys, "epoch", "__bucket").agg(F.sum("__tokens").alias("bucket_tokens"))
    leaves = (sums.where("epoch = 0").groupBy(*keys).agg(F.sum("bucket_tokens").cast("long").alias("tokens")))
    plan = budgets(leaves, keys, by_key, budget, epochs).select(*keys, "budget")
    run = Window.partitionBy(*keys).orderBy("epoch", "__bucket")
    cuts = (sums.join(plan, keys).withColumn("upto", F.sum("bucket_tokens").over(run))
            .withColumn("start", F.col("upto") - F.col("bucket_tokens"))
            .where("budget > 0"))
    # per leaf: the first bucket that does not fit whole; none: everything is taken
    ends = (cuts.groupBy(*keys)
            .agg(F.min(F.when(F.col("upto") > F.col("budget"), F.struct("epoch", "__bucket", "start", "budget"))).alias("end")))
    ends = materialize(ends)
    here = rows.join(F.broadcast(ends) if ends.count() <= BROADCAST_LEAVES else ends, keys)
    place = F.struct("epoch", "__bucket")
    stop = F.struct(F.col("end.epoch"), F.col("end.__bucket"))
    whole = here.where(F.col("end").isNull() | (place < stop))
    edge = here.where(place == stop)
    digest = F.md5(F.coalesce(F.col("__row").getField(text_col).cast("string"), F.lit("")))
    line = (Window.partitionBy(*keys).orderBy("__h", "__id", digest)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = (edge.withColumn("__upto", F.col("end.start") + F.sum("__tokens").over(line))
            .where("__upto <= end.budget").drop("__upto"))
    names = [c for c in df.columns if c not in ("epoch", "n_tokens")]
    return whole.unionByName(kept).select(*[F.col("__row").getField(c).alias(c) for c in names], "epoch", F.col("__tokens").alias("n_tokens"))
