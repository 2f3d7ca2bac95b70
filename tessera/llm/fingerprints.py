"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk wherever its value is
the last residue modulo the block size; each chunk's own hash gives one
base-64 sign.  The block size starts at 3 and doubles until the text's bytes
over it are at most 64 signs' worth, and halves again while the signature
has fewer than 32 signs, as published for context-triggered piecewise hashes.
A fingerprint is ``size:signs:signs2``: the signatures at that size (at most
64 signs) and at twice that size (at most 32).  Chunks beyond the last sign
are hashed into it, so every byte counts.

Likeness of two fingerprints is 1 minus the edit distance of two signatures
at the same block size over the longer one's length (the best of the sizes
they share), after runs of more than three equal signs are cut to three; it
is 0 if the sizes are not compatible, or if the signatures have no common
part of seven signs (of all signs, if shorter), and 1 for equal fingerprints.
Edit distances of a whole batch are computed together, one bit vector of 64
positions per pair (Myers' algorithm as given by Hyyro).

Everything is numpy over batches inside tasks.  Spark orders documents: they
are dealt into blocks of neighbouring ids, and the first document of each
block is also sent to the block before, so that each task sees every
document next to its successor, and no task holds more than a stream of
documents.  Texts are compressed for that one shuffle.

Defined cases: null text counts as empty; the empty text's fingerprint is
``3::``; documents are ordered by id, a null id last, equal ids by a hash of
the text; a single document is its own successor; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 7
SMALLEST = 3
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LENGTH = 64
PART = 7
CHUNK_BYTES = 1 << 20
LAST = 9223372036854775807
_ROLL = [np.uint32(pow(0x01000193, k, 1 << 32)) for k in range(1, WINDOW + 1)]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_UP: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _UP or len(_UP[0]) < n:
        size = max(n, CHUNK_BYTES)
        _UP[:] = []
        for base in (_BASE, _INV):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _UP.append(np.multiply.accumulate(p))
    return _UP[0], _UP[1]


class Rolled:
    """The rolling hash and the running content hash of one text's bytes."""

    def __init__(self, raw: bytes):
        self.n = n = len(raw)
        b = np.frombuffer(raw, dtype=np.uint8)
        wide = b.astype(np.uint32) + np.uint32(1)
        roll = wide * _ROLL[0]
        for k in range(1, min(WINDOW, n)):
            roll[k:] += wide[:n - k] * _ROLL[k]
        roll ^= roll >> np.uint32(15)
        roll *= np.uint32(0x2C1B3C6D)
        self.roll = roll ^ (roll >> np.uint32(13))
        up, _ = _powers(n + 1)
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)))
        self.small = np.flatnonzero(self.roll % np.uint32(SMALLEST) == SMALLEST - 1)

    def signs(self, size: int, most: int) -> str:
        """The signature at a block size (3 times a power of two)."""
        if not self.n:
            return ""
        # a larger size's boundaries are among the smallest size's
        ends = self.small[self.roll[self.small] % np.uint32(size) == size - 1] + 1
        ends = ends[:most - 1]
        start = np.concatenate(([0], ends))
        stop = np.concatenate((ends, [self.n]))
        full = stop > start
        start, stop = start[full], stop[full]
        h = (self.total[stop] - self.total[start]) * _powers(self.n + 1)[1][start]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return "".join(map(SIGNS.__getitem__, (h >> np.uint64(58)).tolist()))


def fingerprint(raw: bytes) -> str:
    size = SMALLEST
    while size * LENGTH < len(raw):
        size *= 2
    rolled = Rolled(raw)
    first = rolled.signs(size, LENGTH)
    while size > SMALLEST and len(first) < LENGTH // 2:
        size //= 2
        first = rolled.signs(size, LENGTH)
    return f"{size}:{first}:{rolled.signs(2 * size, LENGTH // 2)}"


def _short(signs: str) -> str:
    """Runs of more than three equal signs cut to three."""
    if len(signs) < 4:
        return signs
    return "".join(c for i, c in enumerate(signs) if i < 3 or not (c == signs[i - 1] == signs[i - 2] == signs[i - 3]))


def edit_distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Levenshtein distances; the first of each pair has at most 64 signs."""
    n = len(pairs)
    size = np.fromiter((len(a) for a, _ in pairs), np.int64, n)
    other = np.fromiter((len(b) for _, b in pairs), np.int64, n)
    longest = int(other.max(initial=0))
    codes = np.full((n, longest), 255, dtype=np.uint8)
    for i, (_, b) in enumerate(pairs):
        codes[i, :len(b)] = np.frombuffer(b.encode("ascii"), np.uint8)
    where = np.zeros((n, 256), dtype=np.uint64)              # positions of each sign in the first
    one = np.uint64(1)
    for k in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > k)
        sign = np.fromiter((ord(pairs[i][0][k]) for i in rows.tolist()), np.int64, len(rows))
        where[rows, sign] |= one << np.uint64(k)
    plus, minus = np.full(n, ~np.uint64(0)), np.zeros(n, dtype=np.uint64)
    top = one << np.maximum(size - 1, 0).astype(np.uint64)
    score = size.copy()
    rows = np.arange(n)
    for j in range(longest):
        live = (other > j) & (size > 0)
        eq = where[rows, codes[:, j]]
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        hp = minus | ~(d0 | plus)
        hm = plus & d0
        score += np.where(live & ((hp & top) != 0), 1, 0) - np.where(live & ((hm & top) != 0), 1, 0)
        hp = (hp << one) | one
        hm = hm << one
        new_plus = hm | ~(d0 | hp)
        new_minus = hp & d0
        plus, minus = np.where(live, new_plus, plus), np.where(live, new_minus, minus)
    return np.where(size == 0, other, score)


def _shares_part(a: str, b: str) -> bool:
    k = min(PART, len(a), len(b))
    if not k:
        return a == b
    parts = {a[i:i + k] for i in range(len(a) - k + 1)}
    return any(b[i:i + k] in parts for i in range(len(b) - k + 1))


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Likeness, 0 to 1, of each pair of fingerprints."""
    out = np.zeros(len(pairs))
    at, todo = [], []
    for i, (a, b) in enumerate(pairs):
        if a == b:
            out[i] = 1.0
            continue
        x, y = a.split(":"), b.split(":")
        s, t = int(x[0]), int(y[0])
        both = [(x[1], y[1]), (x[2], y[2])] if s == t else [(x[2], y[1])] if 2 * s == t else [(x[1], y[2])] if s == 2 * t else []
        for p, q in both:
            p, q = _short(p), _short(q)
            if p and q and _shares_part(p, q):
                at.append(i)
                todo.append((p, q))
    if todo:
        near = 1.0 - edit_distances(todo) / np.array([max(len(p), len(q)) for p, q in todo])
        np.maximum.at(out, at, near)
    return out


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of
    the following text (or all it has)."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def with_fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``df`` with each whole text's fingerprint."""

    @F.arrow_udf("string")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint((t or "").encode("utf-8", "surrogatepass")) for t in texts.to_pylist()], pa.string())

    return df.withColumn(out_col, prints(F.col(text_col)))


def _blocks(own: DataFrame, blocks: int) -> tuple[np.ndarray, dict[int, tuple[tuple[int, int], int]]]:
    """Ids at which blocks begin, and for each block that has documents its
    first one (id, text hash) and the block before it (the last, for the
    first).  Both are as many numbers as blocks."""
    steps = [i / blocks for i in range(1, blocks)]
    ends = sorted({int(x) for x in own.approxQuantile("id", steps, max(0.2 / blocks, 1e-4))}) if steps else []
    bounds = np.array(ends, dtype=np.int64)

    def least(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            pdf["block"] = np.searchsorted(bounds, pdf["id"].to_numpy(), side="right")
            pdf = pdf.sort_values(["id", "th"]).drop_duplicates("block")
            yield pa.RecordBatch.from_pandas(pdf[["block", "id", "th"]], preserve_index=False)

    firsts = (own.select("id", "th").mapInArrow(least, "block long, id long, th long")
              .groupBy("block").agg(F.min(F.struct("id", "th")).alias("f")).orderBy("block").collect())
    numbers = [r["block"] for r in firsts]
    return bounds, {r["block"]: ((r["f"]["id"], r["f"]["th"]), before)
                    for r, before in zip(firsts, numbers[-1:] + numbers[:-1])}


def with_successors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """(block, tail, id, no_id, th, z): documents in blocks of neighbouring
    ids with compressed texts, ordered within each partition.  A block ends
    with a copy (``tail``) of the document that follows its last one."""
    spark = df.sparkSession
    own = (df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(id_col).isNull().alias("no_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t")))
    bounds, firsts = _blocks(own, blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast((bounds, firsts))

    def dealt(batches):
        bounds, firsts = shared.value
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
            block = np.searchsorted(bounds, ids, side="right")
            z = [pack(t.encode("utf-8", "surrogatepass")) for t in batch.column("t").to_pylist()]
            tails = [i for i, x in enumerate(zip(block.tolist(), ids.tolist(), th.tolist())) if firsts[x[0]][0] == x[1:]]
            at = np.concatenate((np.arange(len(ids)), np.array(tails, dtype=np.int64)))
            to = np.concatenate((block, np.array([firsts[int(block[i])][1] for i in tails], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to.astype(np.int64)), pa.array(np.arange(len(at)) >= len(ids)), pa.array(ids[at]),
                 batch.column("no_id").take(pa.array(at)), pa.array(th[at]), pa.array([z[i] for i in at.tolist()], pa.binary())],
                names=["block", "tail", "id", "no_id", "th", "z"])

    rows = own.mapInArrow(dealt, "block long, tail boolean, id long, no_id boolean, th long, z binary")
    return rows.repartition("block").sortWithinPartitions("block", "tail", "id", "th")


def compare_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """For each document: n_chars, edited (its text with the last quarter
    replaced from the next document's start), fingerprint, edited_fingerprint,
    near_edited and near_next (the likenesses)."""
    names = [id_col, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compared(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        waiting = None                                  # the last document read, whose successor comes next
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                rows = []
                for block, tail, i, no_id, z in zip(*(part.column(c).to_pylist() for c in ("block", "tail", "id", "no_id", "z"))):
                    raw = unpack(z)
                    now = (block, tail, None if no_id else i, raw, raw.decode("utf-8", "surrogatepass"), fingerprint(raw))
                    if waiting is not None and waiting[0] == block and not waiting[1]:
                        new = edited(waiting[4], now[4])
                        rows.append((waiting[2], len(waiting[4]), new, waiting[5], fingerprint(new.encode("utf-8", "surrogatepass")), now[5]))
                    waiting = now
                cols = list(zip(*rows)) if rows else [()] * 6
                near = [likeness(list(zip(cols[3], cols[k]))) for k in (4, 5)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:5]),
                     *(pa.array(x, pa.float64()) for x in near)], names=names)

    schema = f"`{id_col}` long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successors(df, id_col, text_col, blocks).mapInArrow(compared, schema)
