"""Byte-level BPE encoding and decoding over a global distinct-word shuffle.

Encoding goes through four steps.

1. Blocks: each task cuts its documents into blocks of about BLOCK_CHARS
   characters (a longer document is a block of its own) and splits every text
   into pre-tokens.  A block's distinct words get local numbers, the most
   frequent first.
2. Distinct words: each block's words are dealt out by word hash, packed to
   one row per block and bucket.  All copies of a word meet in one bucket,
   whose task runs the merge loop once per distinct word.
3. The ids go back to the blocks, again packed.
4. Positions: the documents' sequences of local numbers (the exploded
   positions, compressed) meet their block's ids, and each document's ids are
   put together by position.

A word occurs once per block, however frequent it is in the corpus, so no
bucket is hot.  Steps 1 and 4 split the texts separately; both read the same
scan, and each block carries a checksum of its words, so that a recomputed
scan that dealt documents otherwise fails loudly instead of giving wrong ids.
The input should therefore be a table as read (files are split alike on every
read); write other frames first.

Decoding looks the ids up in the token-byte table (one row per vocabulary
entry, broadcast: its size is the vocabulary's) and joins the bytes.

Defined cases: null and empty texts have no ids and decode to no bytes; a
null id keeps its row; repeated rows encode alike; long texts and long words
are encoded whole; columns named in ``keep`` pass through, whatever their
names.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_CHARS = 4_000_000
CHUNK_CHARS = 1_000_000
CACHE_WORDS = 1_000_000          # distinct words whose ids a bucket's task keeps
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93           # odd: invertible mod 2^64
_LETTER, _NUMBER, _OTHER, _SPACE, _EDGE = range(5)
# The white space of Unicode.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CLASSES: list[np.ndarray] = []


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    if not _CLASSES:
        first = {"L": _LETTER, "N": _NUMBER}
        own = np.fromiter((first.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        own[_WHITE] = _SPACE
        _CLASSES.append(own)
    return _CLASSES[0]


def pre_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts (each followed by one filler), and the start,
    end and text number of every pre-token, in order.  Equal to matching
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    text by text, found from runs of characters of one class."""
    c = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    edge = np.cumsum(size + 1) - 1                           # the fillers
    kind = _classes()[c]
    kind[edge] = _EDGE
    cut = np.concatenate(([0], np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _EDGE)) + 1, [len(c)]))
    start, end, of = cut[:-1], cut[1:], kind[cut[:-1]]
    solid = of <= _OTHER
    before = np.concatenate(([_EDGE], of[:-1]))
    after = np.concatenate((of[1:], [_EDGE]))
    # a word takes one blank that stands right before it
    blank = solid & (before == _SPACE) & (c[start - 1] == 32)
    first = start - blank
    # contractions: an apostrophe alone, no blank taken, and letters after it
    tick = np.flatnonzero((of == _OTHER) & (end - start == 1) & (c[start] == 39) & ~blank & (after == _LETTER))
    if len(tick):
        room = end[tick + 1] - start[tick + 1]
        a = c[start[tick + 1]]
        b = np.where(room > 1, c[np.minimum(start[tick + 1] + 1, len(c) - 1)], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        took = np.where(one, 1, np.where(two, 2, 0))
        end = end.copy()
        end[tick] += took
        first[tick + 1] += took
    word = solid & (first < end)
    # white space: all of it before an edge; else all but its last character, which stands alone if it is no blank
    space = of == _SPACE
    last = space & (after != _EDGE)
    body_end = np.where(last, end - 1, end)
    body = space & (body_end > start)
    alone = last & (c[end - 1] != 32)
    t_start = np.concatenate((first[word], start[body], end[alone] - 1))
    t_end = np.concatenate((end[word], body_end[body], end[alone]))
    order = np.argsort(t_start, kind="stable")
    t_start, t_end = t_start[order], t_end[order]
    return c, t_start, t_end, np.searchsorted(edge, t_start)


def _hashes(c: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash mod 2^64 of each token, from running sums."""
    n = len(c)
    up = np.full(n, base, dtype=np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[:1] = down[:1] = 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(up), dtype=np.uint64)))
    h = (total[end] - total[start]) * np.multiply.accumulate(down)[start]
    return (h ^ (h >> np.uint64(32))) * np.uint64(_B2)


class Block:
    """The pre-tokens of some documents and their distinct words."""

    def __init__(self, texts: list[str]):
        h1, h2, self.lengths, where = [], [], [], []
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK_CHARS):
                n += len(texts[j])
                j += 1
            c, start, end, doc = pre_tokens(texts[i:j])
            h1.append(_hashes(c, start, end, _B1))
            h2.append(_hashes(c, start, end, _B2))
            base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[i:j]])))[doc]
            where.append(np.stack((doc + i, start - base, end - base)).astype(np.int32))
            self.lengths.append(np.bincount(doc, minlength=j - i))
            i = j
        one, two = np.concatenate(h1), np.concatenate(h2)
        self.lengths = np.concatenate(self.lengths)
        own, at, inverse, count = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
        if not (two[at][inverse] == two).all():
            raise RuntimeError("two words of a block share a 64-bit hash")
        order = np.lexsort((own, -count))
        rank = np.empty(len(own), dtype=np.int32)
        rank[order] = np.arange(len(own), dtype=np.int32)
        self.numbers = rank[inverse]
        self.hashes = own[order]
        self.check = int(np.bitwise_xor.reduce(own).view(np.int64)) if len(own) else 0
        self.first = np.concatenate(where, axis=1)[:, at[order]]
        self.texts = texts

    def words(self) -> list[bytes]:
        texts = self.texts
        return [texts[d][a:b].encode("utf-8", "surrogatepass") for d, a, b in self.first.T.tolist()]


def blocks(batches, text_col: str):
    """(block id, Arrow rows, Block) for the documents of a task, in order."""
    number, rows, chars = TaskContext.get().partitionId() << 24, [], 0
    for batch in batches:
        size = pc.fill_null(pc.utf8_length(batch.column(text_col)), 0).to_pylist()
        a = 0
        for b, n in enumerate(size):
            if chars and chars + n > BLOCK_CHARS:
                rows.append(batch.slice(a, b - a))
                yield _block(number, rows, text_col)
                number, rows, chars, a = number + 1, [], 0, b
            chars += n
        rows.append(batch.slice(a))
    if any(r.num_rows for r in rows):
        yield _block(number, rows, text_col)


def _block(number: int, rows: list[pa.RecordBatch], text_col: str):
    own = pa.Table.from_batches(rows)
    return number, own, Block([t or "" for t in own.column(text_col).to_pylist()])


def _pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Numbers as byte planes (small ones then cost little), then ``tail``."""
    head = np.array([len(arrays), *map(len, arrays)], dtype="<i4").tobytes()
    planes = b"".join(np.ascontiguousarray(a.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + planes + tail)


def _unpack(raw: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    k = int(np.frombuffer(raw, "<i4", 1)[0])
    sizes = np.frombuffer(raw, "<i4", k, 4)
    at, out = 4 * (k + 1), []
    for n in sizes.tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<i4").ravel())
        at += 4 * n
    return out, raw[at:]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: again and again the pair of neighbouring parts
    whose union has the lowest rank (the first of equals) becomes one part."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i:i + 1] for i in range(len(word))]
    if len(parts) > 500:
        return _merge_long(parts, ranks)
    none = len(ranks) + 256
    costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while costs:
        best = min(costs)
        if best == none:
            break
        i = costs.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same for very long words: a heap of pairs and linked parts."""
    import heapq

    n = len(parts)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[parts[i] + parts[i + 1]], i, parts[i], parts[i + 1]) for i in range(n - 1) if parts[i] + parts[i + 1] in ranks]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and parts[i] + parts[j] in ranks:
            heapq.heappush(heap, (ranks[parts[i] + parts[j]], i, parts[i], parts[j]))

    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], nxt[i] = a + b, False, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = nxt[i]
    return out


def encode(df: DataFrame, ranks: dict[bytes, int], keep: list[str] | None = None, text_col: str = "text",
           ids_col: str = "ids", buckets: int | None = None) -> DataFrame:
    """The columns ``keep`` (the id by default) and ``ids_col``, an array of
    token ids, for every row of ``df``."""
    spark = df.sparkSession
    keep = ["doc_id"] if keep is None else list(keep)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(ranks)                                  # the vocabulary
    source = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    kept = [T.StructField(f.name, f.dataType) for f in source.schema.fields[:-1]]

    def distinct(batches):
        for number, _, block in blocks(batches, "text"):
            words = block.words()
            if not words:
                continue
            size = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
            bucket = (block.hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, order[i:j]) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()),
                 pa.array([block.check] * len(rows), pa.int64()),
                 pa.array([_pack(np.diff(at, prepend=0), size[at], tail=b"".join([words[k] for k in at.tolist()])) for _, at in rows],
                          pa.binary())], names=["bucket", "block", "check", "words"])

    def encoded(batches):
        known, table = {}, shared.value
        for batch in batches:
            packs = []
            for raw in batch.column("words").to_pylist():
                (step, size), tail = _unpack(raw)
                ends = np.cumsum(size).tolist()
                ids, count, a = [], [], 0
                for z in ends:
                    word = tail[a:z]
                    a = z
                    got = known.get(word)
                    if got is None:
                        got = known[word] = merge(word, table)
                    ids += got
                    count.append(len(got))
                if len(known) > CACHE_WORDS:
                    known = {}
                packs.append(_pack(step, np.array(count, dtype=np.int32), np.array(ids, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("check"), pa.array(packs, pa.binary())],
                                             names=["block", "check", "ids"])

    def sequences(batches):
        for number, rows, block in blocks(batches, "text"):
            ends = np.cumsum(block.lengths)
            packs = [_pack(block.numbers[e - n:e]) for e, n in zip(ends.tolist(), block.lengths.tolist())]
            n = rows.num_rows
            table = pa.table([pa.array([number] * n, pa.int64()), pa.array([block.check] * n, pa.int64()),
                              pa.array([len(block.hashes)] * n, pa.int64()), pa.array(packs, pa.binary()),
                              *rows.columns[:-1]], names=["block", "check", "n_words", "seq", *rows.column_names[:-1]])
            yield from table.to_batches(max_chunksize=2000)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        n_words = left.column("n_words")[0].as_py()
        count, parts = np.zeros(n_words, dtype=np.int64), []
        for raw in right.column("ids").to_pylist():
            (step, size, ids), _ = _unpack(raw)
            at = np.cumsum(step)
            count[at] = size
            parts.append((at, size, ids))
        checks = set(left.column("check").to_pylist()) | set(right.column("check").to_pylist())
        if len(checks) > 1 or sum(len(p[0]) for p in parts) != n_words:
            raise RuntimeError("a block's documents changed between two reads: write the input first")
        start = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), dtype=np.int32)
        for at, size, ids in parts:
            flat[_spread(start[at], size)] = ids
        values, lengths = [], []
        for raw in left.column("seq").to_pylist():
            (seq,), _ = _unpack(raw)
            ids = flat[_spread(start[seq], count[seq])]
            values.append(ids)
            lengths.append(len(ids))
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        if offsets[-1] > 2**31 - 1:
            raise RuntimeError("a block has more ids than an Arrow list column can hold")
        out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))
        return pa.table([*[left.column(f.name) for f in kept], out], names=[*[f.name for f in kept], "ids"])

    words = source.mapInArrow(distinct, "bucket long, block long, check long, words binary")
    ids = words.repartition("bucket").mapInArrow(encoded, "block long, check long, ids binary")
    row = T.StructType([T.StructField("block", T.LongType()), T.StructField("check", T.LongType()),
                        T.StructField("n_words", T.LongType()), T.StructField("seq", T.BinaryType()), *kept])
    seqs = source.mapInArrow(sequences, row)
    out = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    got = seqs.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(joined, out)
    return got.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], F.col("ids").alias(ids_col))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    size = np.asarray(size, dtype=np.int64)
    jump = np.cumsum(size) - size
    return np.repeat(start - jump, size) + np.arange(int(size.sum()))


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``: the bytes of the ids (null ids: no bytes).  An
    id outside the vocabulary raises."""
    shared = df.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})

    @F.arrow_udf("binary")
    def joined(ids: pa.Array) -> pa.Array:
        token = shared.value.__getitem__
        values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
        return pa.array([b"".join(map(token, values[a:z].tolist())) for a, z in zip(ends, ends[1:])], pa.binary())

    return df.withColumn(out_col, joined(F.coalesce(F.col(ids_col), F.expr("cast(array() as array<int>)"))))
