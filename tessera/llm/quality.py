"""Quality classifier: supervised subword embeddings.

Every document is a bag of hashed features: its words, its pairs of
neighbouring words (hashed by exclusive-or, so that every immediate
repetition is the same feature), and the 3- and 4-character n-grams of each
word, where the white space on either side of a word counts as a boundary
character.  Each hash bucket has a learned vector;
a document is the average of its features' vectors and a softmax layer turns
the average into class probabilities.  Training is plain stochastic gradient
descent in numpy over a bounded sample of labelled rows
(``max_train_docs``), in one task; scoring covers every whole text.

The output layer is linear in the average, so for scoring each bucket is
folded into one number per class pair (its vector times the weight
difference): a document's logit is the mean of its features' numbers.  The
folded table has ``2 ** bits`` floats (1 MB at 18 bits) and is broadcast.

Defined cases: a null or empty text has no features and scores the model's
bias alone; rows with a null id or a null / other label never train; repeated
rows score alike; extra columns are passed through; with no labelled row, or
rows of one class only, the score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 300_000          # characters hashed at once: bounds a task's memory
GRAMS = (3, 4)
_BASE = np.uint64(0x9E3779B97F4A7C15)                    # odd, so invertible mod 2^64
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000], dtype=np.uint32)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return ((h ^ (h >> np.uint64(29))) * _BASE >> np.uint64(64 - bits)).astype(np.int64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def hashed_features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all features of ``texts`` and, aligned with them, the
    index of the text each belongs to (grouped by kind, not by text)."""
    joined = "\n" + "\n".join(texts) + "\n"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    starts = 1 + np.concatenate(([0], np.cumsum(sizes)[:-1]))
    space = np.isin(c, _SPACES) if len(c) < 64 else _is_space(c)
    c = np.where(space, np.uint32(32), c).astype(np.uint64)
    ids, at = [], []
    edge = np.flatnonzero(space)
    first, last = edge[:-1] + 1, edge[1:]                  # words lie between neighbouring spaces
    keep = last > first
    first, last = first[keep], last[keep]
    if len(first):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c * _powers(_BASE, len(c)), dtype=np.uint64)))
        word = (total[last] - total[first]) * _powers(_BASE_INV, len(c))[first]
        ids.append(_bucket(word, bits))
        at.append(first)
        # pairs of neighbouring words of a text, by the exclusive-or of their hashes: any word repeated gives one bucket
        same = np.diff(np.searchsorted(starts, first, side="right")) == 0
        ids.append(_bucket((word[1:] ^ word[:-1])[same] + np.uint64(1), bits))
        at.append(first[1:][same])
    for n in GRAMS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        inner = space[1:m + 1].copy()
        for k in range(2, n - 1):
            inner |= space[k:m + k]
        pos = np.flatnonzero(~inner)
        if not len(pos):
            continue
        h = np.full(len(pos), np.uint64(n), dtype=np.uint64)
        for k in range(n):
            h = h * _BASE + c[pos + k]
        ids.append(_bucket(h, bits))
        at.append(pos + 1)                                # a gram may start at the space before its word
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.searchsorted(starts, np.concatenate(at), side="right") - 1
    return np.concatenate(ids), owner


def _is_space(c: np.ndarray) -> np.ndarray:
    out = (c == 32) | ((c >= 9) & (c <= 13))
    high = np.flatnonzero(c >= 0x85)
    if len(high):
        out[high[np.isin(c[high], _SPACES)]] = True
    return out


def chunks(texts: list[str]):
    """Slices of ``texts`` of about CHUNK_CHARS characters (one text at least)."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK_CHARS):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


@dataclass
class Model:
    bits: int
    table: np.ndarray          # folded bucket numbers, float32
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, j in chunks(texts):
            ids, owner = hashed_features(texts[i:j], self.bits)
            n = np.bincount(owner, minlength=j - i)
            s = np.bincount(owner, weights=self.table[ids], minlength=j - i)
            out[i:j] = s / np.maximum(n, 1) + self.bias
        return 1.0 / (1.0 + np.exp(-out))


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id's text, modulo ``mod``, equals ``rest`` (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def train_sgd(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int, dim: int = 8,
              updates: int = 24_000, lr: float = 2.0, seed: int = 42) -> Model:
    """bags: per document its distinct bucket ids and their counts.  As many
    passes over them as make about ``updates`` updates."""
    rng = np.random.default_rng(seed)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0.0 < share < 1.0:
        logit = 0.0 if not len(y) else (8.0 if share == 1.0 else -8.0)
        return Model(bits, np.zeros(1 << bits, np.float32), logit)
    emb = rng.uniform(-1.0 / dim, 1.0 / dim, size=(1 << bits, dim))
    w, b = np.zeros((2, dim)), np.zeros(2)
    epochs = -(-updates // len(bags))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, cnt = bags[i]
            rate = lr * (1.0 - done / steps)
            done += 1
            if not len(ids):
                continue
            part = cnt / cnt.sum()
            h = part @ emb[ids]
            z = w @ h + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1.0
            grad_h = p @ w
            w -= rate * np.outer(p, h)
            b -= 0.05 * rate * p
            emb[ids] -= (rate * part)[:, None] * grad_h[None, :]
    return Model(bits, (emb @ (w[1] - w[0])).astype(np.float32), float(b[1] - b[0]))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label",
        max_train_docs: int = 2500, bits: int = 18, **sgd) -> Model:
    """Learn from at most ``max_train_docs`` rows of ``labelled`` (the rows of
    the smallest id hashes, so the sample is the same on every run)."""
    rows = (labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y"))
            .where(F.col("id").isNotNull() & F.col("y").isin(0, 1)))
    rows = rows.withColumn("k", F.xxhash64(F.lit("quality"), F.col("id").cast("string")))
    rows = rows.orderBy("k", F.col("id").cast("string"), "y").limit(max_train_docs)

    def learned(it):
        parts = []
        for pdf in it:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for i, j in chunks(texts):
                ids, owner = hashed_features(texts[i:j], bits)
                order = np.argsort(owner, kind="stable")
                ids, owner = ids[order], owner[order]
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                for n, (a, z) in enumerate(zip(cut[:-1], cut[1:]), start=i):
                    u, c = np.unique(ids[a:z], return_counts=True)
                    parts.append((int(pdf["k"].iloc[n]), int(pdf["y"].iloc[n]), u.astype(np.uint32), c.astype(np.uint32)))
        parts.sort(key=lambda x: x[:2])
        model = train_sgd([x[2:] for x in parts], np.array([x[1] for x in parts], dtype=float), bits, **sgd)
        yield pd.DataFrame({"weights": [model.table.tobytes()], "bias": [model.bias]})

    # the bounded sample is one partition: its task extracts features and trains, and returns the folded table
    got = rows.select("k", "y", "text").repartition(1).mapInPandas(learned, "weights binary, bias double").collect()
    if not got:
        return train_sgd([], np.zeros(0), bits)
    return Model(bits, np.frombuffer(bytes(got[0]["weights"]), np.float32), got[0]["bias"])


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df`` with ``out_col``: the probability of label 1, from the whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores([t if isinstance(t, str) else "" for t in texts]))

    return df.withColumn(out_col, scored(F.col(text_col)))


def fit_on_labels(documents: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0,
                  max_train_docs: int = 2500, **kw) -> Model:
    """Learn from ``labels.quality`` of the documents that are not held out.
    The bounded sample is drawn from the narrow label table first, so only
    its documents' texts are read into the training job."""
    lab = (labels.select("doc_id", F.col("quality").cast("int").alias("label"))
           .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), mod, rest))
           .withColumn("k", F.xxhash64(F.lit("quality"), F.col("doc_id").cast("string")))
           .orderBy("k", "doc_id", "label").limit(max_train_docs).drop("k").dropDuplicates(["doc_id"]))
    docs = documents.select("doc_id", "text")
    return fit(docs.join(F.broadcast(lab), "doc_id"), max_train_docs=max_train_docs, **kw)
