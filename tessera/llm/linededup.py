"""Line deduplication by pairwise alignment.

Lines are hashed, and so are the shortest runs of consecutive lines (blank
lines aside) that reach ``min_words`` words, from each line on and up to each
line.  Two documents overlap if they share a run.  For each run its later
holders are paired with its first holder, so a run with n holders gives n - 1
pairs however large n is, every later occurrence has a partner, and every
block of ``min_words`` words gives pairs however frequent its lines are.
The lines of a pair that stand in runs of more than one document are aligned
by patience diff: common ends first, then the longest increasing run of lines
that are unique on both sides, then the gaps between them in the same way.  A
block is a run of aligned lines that follow one another on both sides; blocks
of at least ``min_words`` words are deleted from the later document.  What the
alignment leaves over (lines that repeat, blocks in another order) is matched
run by run.  So a line goes exactly if it stands in a block of ``min_words``
words that any earlier document holds; the first holder of a block keeps it.

Documents are ordered by id, then by a hash of the text.  Only line hashes,
positions and word counts are shuffled; the texts meet the list of deleted
positions at the end.

Defined cases: null text stays null; empty text stays empty; rows equal in id
and text are one document and are edited alike; a null id orders last; blank
lines never match and stay, except that a document whose last word is deleted
becomes empty; long texts are split into lines whole; an empty table gives an
empty result; extra columns of any name pass through (``n_removed`` is replaced); ids
that are no integers are ordered as strings.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import order_key, row_struct, written


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: pairs (i, j) with a[i] == b[j], increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        at = _unique(a, i, m)
        pairs = [(at[h], y) for h, y in sorted(_unique(b, j, n).items(), key=lambda x: x[1]) if h in at]
        run = _increasing(pairs)
        if not run:
            continue
        x, y = i, j
        for p, q in run:
            out.append((p, q))
            todo.append((x, p, y, q))
            x, y = p + 1, q + 1
        todo.append((x, m, y, n))
    return sorted(out)


def _unique(lines: list[int], i: int, j: int) -> dict[int, int]:
    """Position of each line that occurs once between i and j."""
    at: dict[int, int] = {}
    for k in range(i, j):
        at[lines[k]] = -1 if lines[k] in at else k
    return {h: k for h, k in at.items() if k >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that increases on the left (patience sorting)."""
    tops: list[int] = []
    top_at: list[int] = []
    back: list[int] = []
    for k, (x, _) in enumerate(pairs):
        pile = bisect_left(tops, x)
        back.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(x)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = x, k
    out, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def runs(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(start, end) of the shortest runs of lines with ``min_words`` words, from
    each line on and up to each line.  Every line of a block of ``min_words``
    words stands in a run within that block."""
    upto = [0]
    for w in words:
        upto.append(upto[-1] + w)
    out, n, e = [], len(words), 0
    for s in range(n):
        e = max(e, s + 1)
        while e <= n and upto[e] - upto[s] < min_words:
            e += 1
        if e > n:
            break
        out.append((s, e))
    seen, s = set(out), 0
    for e in range(1, n + 1):
        while s + 1 < e and upto[e] - upto[s + 1] >= min_words:
            s += 1
        if upto[e] - upto[s] >= min_words and (s, e) not in seen:
            out.append((s, e))
    return out


def _stretches(lines: list, min_words: int) -> list[tuple[int, int]]:
    """``runs`` of lines whose ordinals follow one another."""
    out, s = [], 0
    for e in range(1, len(lines) + 1):
        if e == len(lines) or lines[e][0] != lines[e - 1][0] + 1:
            out += [(s + i, s + j) for i, j in runs([x[3] for x in lines[s:e]], min_words)]
            s = e
    return out


def removed(first: list, later: list, min_words: int) -> list[int]:
    """Positions that ``later`` loses to ``first``; both are lists of (ordinal
    among the document's lines with words, position, hash, words)."""
    gone: set[int] = set()
    block: list[tuple[int, int]] = []

    def close():
        if sum(later[j][3] for _, j in block) >= min_words:
            gone.update(j for _, j in block)

    a, b = [x[2] for x in first], [x[2] for x in later]
    for i, j in aligned(a, b):
        if block:
            p, q = block[-1]
            if first[i][0] != first[p][0] + 1 or later[j][0] != later[q][0] + 1:
                close()
                block = []
        block.append((i, j))
    close()
    left = [(s, e) for s, e in _stretches(later, min_words) if not gone.issuperset(range(s, e))]
    if left:
        held = {tuple(a[s:e]) for s, e in _stretches(first, min_words)}
        for s, e in left:
            if tuple(b[s:e]) in held:
                gone.update(range(s, e))
    return [later[j][1] for j in sorted(gone)]


def _lines(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, th, pos, h, w, runs): the lines with words of each document, and its
    runs of ``min_words`` words as (hash, first line, last line)."""
    own = (df.select(order_key(df, id_col).alias("id"), F.col(text_col).alias("t"))
           .where("t is not null").withColumn("th", F.xxhash64("t")))
    parts = own.select("id", "th", F.filter(F.transform(F.split("t", "\n", -1), lambda x, i: F.struct(
        i.alias("pos"), F.xxhash64(F.rtrim(x)).alias("h"), F.regexp_count(x, F.lit(r"\S+")).alias("w"))), lambda x: x["w"] > 0).alias("parts"))
    cols = parts.select("id", "th", "parts.pos", "parts.h", "parts.w")

    def with_runs(batches):
        kind = pa.list_(pa.struct([("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            got = []
            for h, w in zip(batch.column("h"), batch.column("w")):
                raw = np.asarray(h.values, "int64").tobytes()
                got.append([(xxhash.xxh64_intdigest(raw[8 * s:8 * e]) - 2 ** 63, s, e - 1) for s, e in runs(w.as_py(), min_words)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kind)], names=[*batch.schema.names, "runs"])

    return cols.mapInArrow(with_runs, f"id {own.schema['id'].dataType.simpleString()}, th long, pos array<int>, h array<long>, w array<int>, "
                                      "runs array<struct<h:long,lo:int,hi:int>>")


def deletions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10) -> DataFrame:
    """(id, th, gone): positions of the lines that each document loses."""
    lines = written(_lines(df, id_col, text_col, min_words), "lines")
    key = F.struct("id", "th")
    held = lines.select("id", "th", F.inline("runs").alias("h", "lo", "hi"))
    # a frequent run is combined before the shuffle
    stats = held.groupBy("h").agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first != last")
    again = written(held.join(written(stats.select("h", "first"), "repeated"), "h").drop("h"), "again")
    pairs = (again.where((F.col("first.id") != F.col("id")) | (F.col("first.th") != F.col("th")))
             .select("id", "th", F.col("first.id").alias("first_id"), F.col("first.th").alias("first_th")).distinct())
    kept = (again.select("id", "th", F.explode(F.sequence("lo", "hi")).alias("ord"))
            .groupBy("id", "th").agg(F.sort_array(F.collect_set("ord")).alias("ords")))
    seqs = (lines.select("id", "th", "pos", "h", "w").join(kept, ["id", "th"])
            .select("id", "th", F.transform("ords", lambda o: F.struct(
                o.alias("ord"), F.get("pos", o).alias("pos"), F.get("h", o).alias("h"), F.get("w", o).alias("w"))).alias("seq")))
    seqs = written(seqs.dropDuplicates(["id", "th"]), "seqs")
    both = (pairs.join(seqs.select(F.col("id").alias("first_id"), F.col("th").alias("first_th"), F.col("seq").alias("a")),
                       ["first_id", "first_th"])
            .join(seqs.withColumnRenamed("seq", "b"), ["id", "th"]))

    def lost(it):
        for pdf in it:
            gone = [removed(*([(int(x["ord"]), int(x["pos"]), int(x["h"]), int(x["w"])) for x in s] for s in (a, b)), min_words)
                    for a, b in zip(pdf["a"], pdf["b"])]
            out = pd.DataFrame({"id": pdf["id"], "th": pdf["th"], "gone": gone})
            yield out[out["gone"].map(len) > 0]

    found = both.select("id", "th", "a", "b").mapInPandas(lost, f"id {lines.schema['id'].dataType.simpleString()}, th long, gone array<int>")
    return found.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10) -> DataFrame:
    """``df`` with the repeated blocks of later documents deleted from the
    text, and ``n_removed``, the number of lines deleted."""
    gone = deletions(df, id_col, text_col, min_words)
    own = df.select(row_struct(df).alias("row"), order_key(df, id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    left = F.concat_ws("\n", F.filter(F.split("t", "\n", -1), lambda x, i: ~F.array_contains("gone", i)))
    kept = (F.when(F.col("gone").isNull(), F.col("t"))
            .otherwise(F.when(F.length(F.trim(F.regexp_replace(left, r"\s+", " "))) > 0, left).otherwise(F.lit(""))))
    return own.join(gone, ["id", "th"], "left").select(
        *[kept.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns if c != "n_removed"],
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
