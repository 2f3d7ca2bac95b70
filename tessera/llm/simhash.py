"""SimHash near-duplicates by multi-index hashing.

Fingerprint: a text's A-Z are lower-cased, its words are the runs without
ASCII white space, its shingles are ``shingle_words`` consecutive words
joined by one space (repeats count; a shorter text is one shingle of all its
words).  Bit b of the 64-bit fingerprint is 1 if it is set in more than half
of the shingles' XXH64 values (seed 42, unsigned).  No word: fingerprint 0.

Links: two fingerprints link if at most ``max_bits`` bits differ.  They are
cut into ``segments`` parts; by the pigeonhole principle two such
fingerprints agree in some part up to ``max_bits // segments`` bits.  Each
distinct fingerprint is filed once per part (a table per part) and looks up
every value in the small Hamming ball around its own part.  The matches of a
key are compared over all 64 bits in blocks, and only a spanning forest of
the links found leaves the task, never all pairs of a group.  A key's rows
are dealt out over ``salts`` tasks: look-ups by hash, filed rows to each.
Distinct fingerprints alone are linked; copies join by fingerprint after.

Defined cases: null text counts as empty; a null id keeps its row with a
null component; repeated ids and rows keep one row each; with no rows the
result is empty; extra columns pass through.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.session import materialize

SEED = 42
SALTS = 8
BLOCK_CELLS = 4_000_000           # look-ups x filed rows compared at once


def fingerprint(text: str | None, shingle_words: int) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()     # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    end = np.cumsum(size) - 1
    first = (end - size + 1)[:n].tolist()
    last = (end[shingle_words - 1:] if len(words) >= shingle_words else end[-1:]).tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for a in range(0, n, 65_536):
        raw = b"".join([digest(line[i:j], SEED) for i, j in zip(first[a:a + 65_536], last[a:a + 65_536])])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def with_fingerprints(df: DataFrame, text_col: str = "text", shingle_words: int = 5, out_col: str = "fp") -> DataFrame:
    """``df`` with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        raw = np.array([fingerprint(t if isinstance(t, str) else "", shingle_words) for t in texts], dtype=np.uint64)
        return pd.Series(raw.view(np.int64))

    return df.withColumn(out_col, prints(F.col(text_col)))


def _parts(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment of the 64 bits."""
    edge = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edge[:-1], edge[1:])]


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between positions a and b of ``nodes``: each linked node
    and the smallest node (unsigned order aside) reached from it."""
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            break
        root = least
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _links_of(filed: np.ndarray, asked: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between look-ups and filed rows of one key."""
    found_a, found_b = [], []
    step = max(1, BLOCK_CELLS // max(1, len(filed)))
    for i in range(0, len(asked), step):
        near = np.bitwise_count(asked[i:i + step, None] ^ filed[None, :]) <= max_bits
        x, y = np.nonzero(near)
        if not len(x):
            continue
        nodes, at = np.unique(np.concatenate((asked[i + x], filed[y])), return_inverse=True)
        u, v = _forest(nodes, at[:len(x)], at[len(x):])
        found_a.append(u)
        found_b.append(v)
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(found_a), np.concatenate(found_b)


def fingerprint_links(prints: DataFrame, fp_col: str = "fp", max_bits: int = 3, segments: int = 3,
                      salts: int = SALTS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect exactly those
    that chains of at most ``max_bits`` differing bits connect."""
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes, but many rows to come: the filing below runs in as many tasks as a shuffle has (by
    # another expression than distinct's own, which Spark would take for the same partitioning and coalesce)
    own = prints.select(F.col(fp_col).alias("fp")).where("fp is not null").distinct().repartition(tasks, F.xxhash64("fp", F.lit("file")))
    radius = max_bits // segments
    masks, keys = [], []
    for number, (shift, width) in enumerate(_parts(segments)):
        for m in _ball(width, radius):
            # bits of the key: the segment's value with the mask's bits turned, then the segment's number
            part = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1)).bitwiseXOR(F.lit(m))
            (masks if m else keys).append(F.shiftleft(part, 6).bitwiseOR(F.lit(number)))
    salt = F.pmod(F.xxhash64("fp"), F.lit(salts))
    # a filed row goes to every salt, a look-up to its own; the row's own key is looked up too
    rows = [F.struct(k.alias("key"), F.lit(s).cast("long").alias("salt"), F.lit(True).alias("filed")) for k in keys for s in range(salts)]
    rows += [F.struct(k.alias("key"), salt.alias("salt"), F.lit(False).alias("filed")) for k in keys + masks]
    dealt = (own.select("fp", F.explode(F.array(*rows)).alias("r")).select("r.key", "r.salt", "r.filed", "fp")
             .repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("filed")))

    def matched(batches):
        """Rows come ordered by key and salt, filed rows before look-ups."""
        key, filed, asked = None, [], []

        def flush():
            if filed and asked:
                return _links_of(np.concatenate(filed), np.concatenate(asked), max_bits)
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).to_numpy(zero_copy_only=False)
            s = batch.column(1).to_numpy(zero_copy_only=False)
            is_filed = batch.column(2).to_numpy(zero_copy_only=False)
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            edge = np.concatenate(([0], np.flatnonzero((np.diff(k) != 0) | (np.diff(s) != 0)) + 1, [len(k)]))
            # keys with a single filed row and its own look-up give nothing; look only at the rest
            out_a, out_b = [], []
            n_filed = np.add.reduceat(is_filed.astype(np.int64), edge[:-1])
            length = np.diff(edge)
            look = (n_filed > 0) & (n_filed < length) & ~((length == 2) & (fp[edge[:-1]] == fp[edge[1:] - 1]))
            look[[0, -1]] = True                      # these may go on in the neighbouring batch
            for g in np.flatnonzero(look).tolist():
                i, j = int(edge[g]), int(edge[g + 1])
                if (k[i], s[i]) != key:
                    a, b = flush()
                    out_a.append(a)
                    out_b.append(b)
                    key, filed, asked = (k[i], s[i]), [], []
                m = i + int(n_filed[g])
                if m > i:
                    filed.append(fp[i:m])
                if j > m and filed:
                    asked.append(fp[m:j])
                    if sum(map(len, asked)) * sum(map(len, filed)) >= BLOCK_CELLS:
                        a, b = flush()
                        out_a.append(a)
                        out_b.append(b)
                        asked = []
            if out_a:
                yield _pairs(np.concatenate(out_a), np.concatenate(out_b))
        a, b = flush()
        yield _pairs(a, b)

    return dealt.mapInArrow(matched, "a long, b long").where("a != b").distinct()


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    max_bits: int = 3, segments: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``id_col``, fp, component_id, component, *``keep``) per row of ``df``:
    component_id is the smallest id reachable over links, the row's own
    included, component the smallest fingerprint.  ``keep`` names columns of
    ``df`` to carry along."""
    rows = materialize(with_fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep), "text",
                                         shingle_words).select("id", "fp", *keep))
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    links = materialize(fingerprint_links(rows, "fp", max_bits, segments))
    group = components(links, "a", "b").withColumnRenamed("node", "fp")
    # a component's id: the least document of all its fingerprints
    known = least.join(group, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    top = known.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = known.join(top, "component").select("fp", "component_id", "component")
    return (rows.join(by_print, "fp", "left")
            .select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
                    "component", *keep))
