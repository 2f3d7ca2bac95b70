"""Substring deduplication with suffix automata of reference shards.

Words are the runs of non-blank characters, a window is ``min_words``
consecutive words of one document, and a word goes if a window covers it whose
words also start earlier: in a document of a smaller id, or earlier in the
same one.  Windows are judged on the input.

Every window is filed under its minimizer: the least hash among its runs of
``seed_words`` words, so that equal windows have equal minimizers.  A context
is a run of windows with one minimizer position; every window stands in
exactly one context.  Then:

1. minimizers are counted; a bitmap of fixed size (``filter_bits``) of those
   that occur again lets the second reading keep candidate contexts only (a
   false hit costs time, never a result);
2. equal contexts of one minimizer are combined before the shuffle; only the
   first of each is reference text, and all later ones are repetitions whole;
3. contexts are dealt by minimizer to shards of about ``shard_contexts``.  A
   shard's suffix automaton holds its contexts in document order, and every
   state knows the end of its first occurrence.  The documents' contexts are
   streamed through it; their matching statistics give, for every window, the
   place where its words first occur, and a window that is not that place is
   removed;
4. the maximal spans of removed windows meet the texts at the end.

An automaton over all references, sent to every executor, would grow with the
corpus, and so would the work of every document.  Instead each shard's
automaton, of bounded size, lives in the one task that gets the contexts which
could match it.  A minimizer with more than ``hot_contexts`` different contexts
fits no shard: its windows are judged by a hash of the window, combined before
the shuffle, with the same result.

Defined cases: null text stays null and has no words; a text without words
becomes empty; every other text becomes its kept words joined by one space;
documents of one id are ordered by a hash of the text, and rows equal in id
and text are one document and are edited alike; a null id orders last; ids of
other than integer types are ordered as strings; long texts are read whole, a
piece at a time; an empty table gives an empty result; extra columns pass
through (``n_words`` and ``n_removed`` are replaced).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tables import order_key, row_struct, written

BLANK = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20          # bytes of a text that are split at once
SLICE = 200_000          # words that are hashed together
FACTOR = np.uint64(0x9E3779B97F4A7C17)
INVERSE = np.uint64(pow(int(FACTOR), -1, 2 ** 64))


class Automaton:
    """Suffix automaton of several words sequences, added one after another.
    ``first[v]`` is the place at which the strings of state v first ended."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.first = [-1], [0], [-1]

    def _state(self, length: int, link: int, edges: dict, first: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        self.first.append(first)
        return len(self.len) - 1

    def _split(self, p: int, w, q: int) -> int:
        """A state for the strings of q that are one longer than those of p."""
        c = self._state(self.len[p] + 1, self.link[q], self.next[q].copy(), self.first[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def add(self, words: list, place: int) -> None:
        """Add a sequence; the place of its first word is ``place``."""
        edges, link, length = self.next, self.link, self.len
        last = 0
        for w in words:
            q = edges[last].get(w)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, w, q)
                place += 1
                continue
            new = self._state(length[last] + 1, 0, {}, place)
            p = last
            while p >= 0 and w not in edges[p]:
                edges[p][w] = new
                p = link[p]
            if p >= 0:
                q = edges[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = new
            place += 1

    def statistics(self, words: list, size: int):
        """(matched, first) after each word: the length of the longest suffix
        that occurs, kept no longer than telling strings of ``size`` words apart
        needs, and the place where that state's strings first ended."""
        edges, link, length, first = self.next, self.link, self.len, self.first
        v = n = 0
        for w in words:
            while v and w not in edges[v]:
                v = link[v]
                n = length[v]
            v = edges[v].get(w, 0)
            n = n + 1 if v else 0
            while length[link[v]] >= size:
                v = link[v]
                n = length[v]
            yield n, first[v]


def repeated(contexts: list[list], size: int) -> list[list[int]]:
    """Of each context, in order, the windows that start earlier, in it or in one before."""
    automaton, starts, at = Automaton(), [], 0
    for words in contexts:
        automaton.add(words, at)
        starts.append(at)
        at += len(words)
    out = []
    for start, words in zip(starts, contexts):
        out.append([i - size + 1 for i, (n, first) in enumerate(automaton.statistics(words, size)) if n >= size and first < start + i])
    return out


def word_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every word."""
    parts, at = [], 0
    while at < len(text):
        cut = BLANK.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class Ranges:
    """Hashes of ranges of a word-hash array."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        self.back = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, INVERSE))))
        powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(n - 1, 0), FACTOR))))[:n]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(h * powers)))

    def of(self, start: np.ndarray, size) -> np.ndarray:
        g = (self.sums[start + size] - self.sums[start]) * self.back[start]
        g = (g ^ (g >> np.uint64(32))) * FACTOR
        return g ^ (g >> np.uint64(29))


def contexts_of(h: np.ndarray, doc: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, ...]:
    """(start, windows, minimizer, hash) of every context in the words ``h`` of the documents ``doc``."""
    n = len(h) - size + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    ranges = Ranges(h)
    value = ranges.of(np.arange(len(h) - seed + 1), seed)
    place = np.arange(len(value))
    own, width = value, 1
    reach = size - seed + 1                        # runs of seed words in a window
    while width < reach:                           # least of ever wider neighbourhoods, the leftmost of equal ones
        step = min(width, reach - width)
        m = len(value) - step
        later = value[step:] < value[:m]
        value, place = np.where(later, value[step:], value[:m]), np.where(later, place[step:], place[:m])
        width += step
    starts = np.flatnonzero(doc[:n] == doc[size - 1:])
    place = place[starts]
    lo = np.flatnonzero(np.concatenate((np.ones(min(1, len(place)), bool), place[1:] != place[:-1])))
    count = np.diff(np.concatenate((lo, [len(place)])))
    first = starts[lo]
    return first, count, own[place[lo]], ranges.of(first, count + size - 1)


def _slices(batch, text_col: str):
    """(row numbers, word hashes, document of each word) of the batch's texts, some SLICE words at a time."""
    rows, parts, total = [], [], 0
    for i, text in enumerate(batch.column(text_col)):
        raw = text.as_buffer()
        h = word_hashes(raw.to_pybytes()) if raw is not None else np.zeros(0, np.uint64)
        rows.append(i)
        parts.append(h)
        total += len(h)
        if total >= SLICE:
            yield rows, np.concatenate(parts), np.repeat(rows, [len(p) for p in parts])
            rows, parts, total = [], [], 0
    if rows:
        yield rows, np.concatenate(parts), np.repeat(rows, [len(p) for p in parts])


def _keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, t, row): the order of the documents, the text, and all columns."""
    return df.select(order_key(df, id_col).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("th"), F.col(text_col).cast("string").alias("t"),
                     row_struct(df).alias("row"))


def _bitmap(seen: DataFrame, bits: int) -> np.ndarray:
    """A bit for the leading ``bits`` bits of every minimizer that occurs again: a table of 2^(bits - 6) longs at most."""
    slot = F.shiftrightunsigned("m", 64 - bits)
    rows = (seen.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(m, {64 - bits}) & 63L as int))").alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bit").to_numpy().view(np.uint64)
    return out


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, seed_words: int = 8,
          filter_bits: int = 26, shard_contexts: int = 4000, hot_contexts: int = 4000) -> DataFrame:
    """(id, th, starts, ends): ranges of word positions that each document loses, unmerged."""
    spark, size = df.sparkSession, min_words
    docs = _keys(df, id_col, text_col).select("id", "th", "t").where("t is not null")
    id_type = docs.schema["id"].dataType.simpleString()

    def minimizers(batches):
        for batch in batches:
            for _, h, doc in _slices(batch, "t"):
                m, n = np.unique(contexts_of(h, doc, size, seed_words)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(n)], names=["m", "n"])

    counts = docs.select("t").mapInArrow(minimizers, "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))
    again = spark.sparkContext.broadcast(_bitmap(counts.where("n > 1"), filter_bits))
    drop = np.uint64(64 - filter_bits)

    def candidates(batches):
        for batch in batches:
            for rows, h, doc in _slices(batch, "t"):
                lo, n, m, c = contexts_of(h, doc, size, seed_words)
                slot = m >> drop
                keep = (again.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
                lo, n, m, c = lo[keep], n[keep], m[keep], c[keep]
                if not len(lo):
                    continue
                # the words of all kept contexts, each once: contexts overlap in order
                end = lo + n + size - 1
                held = np.zeros(len(h) + 1, np.int64)
                np.add.at(held, lo, 1)
                np.add.at(held, end, -1)
                held = np.cumsum(held)[:-1] > 0
                slots = np.cumsum(held) - 1
                own = doc[lo]
                cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                edge = np.concatenate((cuts, [len(own)]))
                first = np.searchsorted(doc, own[cuts])                    # first word of each document
                lists = lambda a: pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(a))
                heads = slots[lo[cuts]]
                word_edge = np.concatenate((heads, [held.sum()]))
                per = np.repeat(np.arange(len(cuts)), np.diff(edge))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(own[cuts])), batch.column("th").take(pa.array(own[cuts])),
                     lists((lo - first[per]).astype(np.int32)), lists(n.astype(np.int32)), lists(m.view(np.int64)), lists(c.view(np.int64)),
                     lists((slots[lo] - heads[per]).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(word_edge, pa.int32()), pa.array(h[held].view(np.int64)))],
                    names=["id", "th", "lo", "n", "m", "c", "at", "words"])

    cand = written(docs.mapInArrow(candidates, f"id {id_type}, th long, lo array<int>, n array<int>, m array<long>, c array<long>, "
                                               "at array<int>, words array<long>"), "contexts")
    # the first of equal contexts, combined before the shuffle
    occ = cand.select("id", "th", F.inline(F.arrays_zip("lo", "m", "c")))
    heads = written(occ.groupBy("m", "c").agg(F.min(F.struct("id", "th", "lo")).alias("first"), F.count("*").alias("k")), "heads")
    per = heads.groupBy("m").agg(F.count("*").alias("contexts"), F.sum("k").alias("k"))
    owned = (heads.select("m", "first.*").join(per, "m")
             .select("id", "th", "lo", F.when(F.col("k") < 2, 0).when(F.col("contexts") > hot_contexts, 2).otherwise(1).alias("way"))
             .groupBy("id", "th").agg(F.collect_list(F.struct("lo", "way")).alias("owned")))

    def dealt(batches):
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                doc, th = batch.column("id")[r].as_py(), batch.column("th")[r].as_py()
                lo, n, m, at, words = (np.asarray(batch.column(x)[r].values) for x in ("lo", "n", "m", "at", "words"))
                way = np.full(len(lo), -1)
                if batch.column("owned")[r].is_valid:
                    own = batch.column("owned")[r].values
                    way[np.searchsorted(lo, np.asarray(own.field("lo")))] = np.asarray(own.field("way"))
                copies = np.flatnonzero(way < 0)
                if len(copies):
                    out.append((doc, th, 0, None, lo[copies].tolist(), (lo[copies] + n[copies] + size - 1).tolist(), None))
                for i in np.flatnonzero(way == 1):
                    out.append((doc, th, 1, int(m[i]), [int(lo[i])], None, words[at[i]:at[i] + n[i] + size - 1].tolist()))
                hot = np.flatnonzero(way == 2)
                if len(hot):
                    ranges = Ranges(words.view(np.uint64))
                    for i in hot:
                        starts = np.arange(n[i])
                        out.append((doc, th, 2, int(m[i]), (lo[i] + starts).tolist(), None, ranges.of(at[i] + starts, size).view(np.int64).tolist()))
            kinds = [batch.schema.field("id").type, pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)],
                                             names=["id", "th", "way", "m", "starts", "ends", "words"])

    pieces = written(cand.join(owned, ["id", "th"], "left").mapInArrow(
        dealt, f"id {id_type}, th long, way int, m long, starts array<int>, ends array<int>, words array<long>"), "pieces")
    copies = pieces.where("way = 0").select("id", "th", "starts", "ends")

    def judged(table: pa.Table) -> pa.Table:
        ids, th, lo = (table.column(c).to_pylist() for c in ("id", "th", "starts"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i], th[i], lo[i]))
        words = table.column("words").combine_chunks()
        flat, edge = words.flatten().to_pylist(), np.concatenate(([0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False)))).tolist()
        found = repeated([flat[edge[i]:edge[i + 1]] for i in order], size)
        got = [(ids[i], th[i], [lo[i][0] + x for x in f]) for i, f in zip(order, found) if f]
        return pa.table([pa.array([g[0] for g in got], table.schema.field("id").type), pa.array([g[1] for g in got], pa.int64()),
                         pa.array([g[2] for g in got], pa.list_(pa.int32()))], names=["id", "th", "starts"])

    shards = max(1, -(-pieces.where("way = 1").count() // shard_contexts))
    matched = (pieces.where("way = 1").select(F.pmod(F.xxhash64("m"), F.lit(shards)).alias("shard"), "id", "th", "starts", "words")
               .groupBy("shard").applyInArrow(judged, f"id {id_type}, th long, starts array<int>"))
    ends = F.transform("starts", lambda x: (x + size).cast("int"))
    hot = pieces.where("way = 2").select("id", "th", "m", F.inline(F.arrays_zip(F.col("starts").alias("start"), F.col("words").alias("w"))))
    first = hot.groupBy("m", "w").agg(F.min(F.struct("id", "th", "start")).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    later = (hot.join(first, ["m", "w"]).where(F.struct("id", "th", "start") != F.col("first"))
             .groupBy("id", "th").agg(F.collect_list("start").alias("starts")))
    return copies.unionByName(matched.withColumn("ends", ends)).unionByName(later.withColumn("ends", ends))


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, **options) -> DataFrame:
    """``df`` with the text cut down to the words that stay, ``n_words`` of the
    text as it was and ``n_removed`` of them; ``options`` as for ``spans``."""
    if min_words < 1:
        raise ValueError("min_words must be 1 at least")
    options["seed_words"] = min(options.get("seed_words", 8), min_words)
    gone = (spans(df, id_col, text_col, min_words, **options).groupBy("id", "th")
            .agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")))
    both = _keys(df, id_col, text_col).join(gone, ["id", "th"], "left").select("row", "t", "starts", "ends")

    def kept(batches):
        for batch in batches:
            texts, words, removed = [], [], []
            for text, lo, hi in zip(batch.column("t"), batch.column("starts"), batch.column("ends")):
                raw = text.as_buffer()
                own = raw.to_pybytes().split() if raw is not None else []
                words.append(len(own))
                if lo.is_valid:
                    steps = np.zeros(len(own) + 1, np.int64)
                    np.add.at(steps, np.asarray(lo.values), 1)
                    np.add.at(steps, np.asarray(hi.values), -1)
                    stays = np.cumsum(steps)[:-1] <= 0
                    own = [own[i] for i in np.flatnonzero(stays)]
                removed.append(words[-1] - len(own))
                texts.append(None if raw is None else b" ".join(own))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string()),
                                              pa.array(words, pa.int64()), pa.array(removed, pa.int64())], names=["row", "t", "w", "r"])

    out = both.mapInArrow(kept, T.StructType([T.StructField("row", both.schema["row"].dataType), T.StructField("t", T.StringType()),
                                              T.StructField("w", T.LongType()), T.StructField("r", T.LongType())]))
    names = {"n_words": "w", "n_removed": "r"}
    cols = [F.col("t").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in df.columns if c not in names]
    return out.select(*cols, *[F.col(v).alias(k) for k, v in names.items()])
