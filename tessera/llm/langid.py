"""Language identification: segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public
vocabulary.  The probability of a word is the sum, over all ways of cutting
it into pieces, of the products of the pieces' probabilities: a forward
algorithm over character positions computes it.  Pieces never cross white
space (the vocabulary marks word starts), so a text's log-likelihood is the
sum of its words' logarithms, and a task runs the forward algorithm once for
each distinct word it meets, for all words of one length and all languages
at a time.

Piece probabilities are smoothed relative counts of the vocabulary's own
segmentation over a bounded sample of labelled rows (``max_train_docs``);
the count table has at most vocabulary size x languages rows.

Defined cases: null text, or text without a letter (Unicode category L): ``und`` with score 0;
without any labelled row every text is ``und``; a character that no piece
covers has one fixed small probability in every language; ties go to the
alphabetically first language; very long words are scored whole (the forward
variables are rescaled); extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.quality import chunks
from tessera.llm.tables import free_name

UNKNOWN = 1e-9                   # probability of a character that is no piece
CACHE_WORDS = 400_000            # distinct words a task keeps before it starts afresh
FRESH_WORDS = 50_000             # new words that make a pass of the forward algorithm
FRESH_CHARS = 4_000_000          # text held back for it at most
_B = np.uint64(0x100000001B3)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MARK = "▁"                  # the vocabulary's word-start sign


def piece_hash(chars: np.ndarray) -> np.uint64:
    h = np.uint64(0)
    for c in chars:
        h = h * _B + np.uint64(c) + np.uint64(1)
    return h


class PieceTable:
    """Piece lookup by hash for whole arrays: one open table, and a small
    second one for the few pieces whose slots clash in the first."""

    def __init__(self, pieces: list[str], bits: int = 20):
        with np.errstate(over="ignore"):
            hashes = np.array([piece_hash(np.frombuffer(p.encode("utf-32-le"), "<u4")) for p in pieces], dtype=np.uint64)
        self.hashes = np.concatenate((hashes, np.zeros(1, np.uint64)))
        self.none, self.bits = len(pieces), bits
        self.longest = max(map(len, pieces), default=1)
        self.first = np.full(1 << bits, self.none, dtype=np.int32)
        slot = (hashes * _K1 >> np.uint64(64 - bits)).astype(np.int64)
        self.first[slot[::-1]] = np.arange(len(pieces), dtype=np.int32)[::-1]
        left = np.flatnonzero(self.first[slot] != np.arange(len(pieces)))
        self.second = np.full(1 << bits, self.none, dtype=np.int32)
        slot2 = (hashes[left] * _K2 >> np.uint64(64 - bits)).astype(np.int64)
        self.second[slot2] = left.astype(np.int32)
        self.rest = {int(hashes[i]): int(i) for i in left[self.second[slot2] != left]}

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each hash, ``none`` where there is no such piece."""
        a = self.first[(h * _K1 >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.where(self.hashes[a] == h, a, self.none)
        b = self.second[(h * _K2 >> np.uint64(64 - self.bits)).astype(np.int64)]
        hit = (b != self.none) & (self.hashes[b] == h)
        out[hit] = b[hit]
        for k, i in self.rest.items():
            out[h == np.uint64(k)] = i
        return out


def word_loglik(words: list[str], table: PieceTable, prob: np.ndarray) -> np.ndarray:
    """log P(word) for each word and language: ``prob`` is pieces x languages."""
    out = np.empty((len(words), prob.shape[1]))
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order])) + 1
    for block in np.split(order, cut):
        n = int(size[block[0]]) if len(block) else 0
        step = max(1, 200_000 // max(n, 1))
        for a in range(0, len(block), step):
            rows = block[a:a + step]
            raw = "".join(MARK + words[i] for i in rows).encode("utf-32-le", "surrogatepass")
            out[rows] = _forward(np.frombuffer(raw, "<u4").reshape(len(rows), n), table, prob)
    return out


def _forward(chars: np.ndarray, table: PieceTable, prob: np.ndarray) -> np.ndarray:
    n, size = chars.shape
    chars = chars.T.astype(np.uint64) + np.uint64(1)
    window = table.longest
    alpha = np.zeros((size + 1, n, prob.shape[1]))
    alpha[0] = 1.0
    scale = np.zeros((n, 1))
    for j in range(size):
        if j and j % 8 == 0:                                   # keep within floating range
            part = alpha[j:min(size, j + window) + 1]
            top = np.maximum(part.max(axis=(0, 2)), 1e-300)[:, None]
            part /= top[None]
            scale += np.log(top)
        h = np.zeros(n, dtype=np.uint64)
        for e in range(j + 1, min(size, j + window) + 1):
            h = h * _B + chars[e - 1]
            piece = table.find(h)
            hit = np.flatnonzero(piece != table.none)
            if len(hit):
                alpha[e, hit] += alpha[j, hit] * prob[piece[hit]]
            if e == j + 1 and len(hit) < n:
                miss = np.flatnonzero(piece == table.none)
                alpha[e, miss] += alpha[j, miss] * UNKNOWN
    return np.log(np.maximum(alpha[size], 1e-300)) + scale


class Model:
    def __init__(self, langs: list[str], pieces: list[str], prob: np.ndarray):
        self.langs, self.pieces, self.prob = langs, pieces, prob
        self.table = PieceTable(pieces)

    def predict(self, batches):
        """For each list of texts: (languages, scores).  New words are gathered
        over lists, FRESH_WORDS of them or FRESH_CHARS of text, before the
        forward algorithm runs for them."""
        number: dict[str, int] = {}
        logs = np.zeros((0, len(self.langs)))
        waiting: list[tuple[list, list]] = []
        fresh: set[str] = set()
        chars = 0

        def known() -> None:
            nonlocal number, logs, fresh
            if len(number) + len(fresh) > CACHE_WORDS and number:
                number, logs = {}, np.zeros((0, len(self.langs)))
                fresh = {w for _, split in waiting for ws in split for w in ws}
            if fresh:
                words = list(fresh)
                number.update(zip(words, range(len(number), len(number) + len(words))))
                logs = np.concatenate((logs, word_loglik(words, self.table, self.prob)))
                fresh = set()

        for texts in batches:
            split = [t.split() if isinstance(t, str) else [] for t in texts]
            fresh.update(w for ws in split for w in ws if w not in number)
            waiting.append((texts, split))
            chars += sum(len(t) for t in texts if isinstance(t, str))
            if len(fresh) >= FRESH_WORDS or chars >= FRESH_CHARS:
                known()
                yield from (self._scored(*w, number, logs) for w in waiting)
                waiting, chars = [], 0
        known()
        yield from (self._scored(*w, number, logs) for w in waiting)

    def _scored(self, texts: list, split: list, number: dict, logs: np.ndarray) -> tuple[list, list]:
        langs, scores = [], []
        for t, ws in zip(texts, split):
            if not self.langs or not ws or not any(map(str.isalpha, t)):
                langs.append("und")
                scores.append(0.0)
                continue
            total = logs[np.fromiter(map(number.__getitem__, ws), dtype=np.int64, count=len(ws))].sum(axis=0)
            k = int(total.argmax())
            langs.append(self.langs[k])
            scores.append(float(1.0 / np.exp(total - total[k]).sum()))
        return langs, scores


def fit(labelled: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_train_docs: int = 4000, smoothing: float = 0.5) -> Model:
    """Learn piece probabilities from at most ``max_train_docs`` rows (those of
    the smallest id hashes).  ``model_path``: the public piece vocabulary."""
    import sentencepiece

    with open(model_path, "rb") as f:
        raw = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    normal = [i for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    shared = labelled.sparkSession.sparkContext.broadcast(raw)
    rows = (labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
            .where("lang is not null and text is not null and id is not null"))
    # the sample is drawn from ids alone; only its rows' texts leave the scan
    sample = (rows.select("id", "lang").withColumn("k", F.xxhash64(F.lit("langid"), "id")).orderBy("k", "id", "lang")
              .limit(max_train_docs).select("id", "lang").distinct())
    rows = rows.join(F.broadcast(sample), ["id", "lang"], "left_semi")                 # at most max_train_docs rows

    def counted(it):
        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for pdf in it:
            for lang, group in pdf.groupby("lang"):
                ids = np.concatenate([np.asarray(x, dtype=np.int64) for x in sp.encode(list(group["text"]), num_threads=1)]
                                     or [np.zeros(0, np.int64)])
                piece, n = np.unique(ids, return_counts=True)
                yield pd.DataFrame({"lang": lang, "piece": piece, "n": n})

    got = (rows.select("lang", "text").mapInPandas(counted, "lang string, piece long, n long")
           .groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(got["lang"].unique())
    counts = np.zeros((sp.get_piece_size(), len(langs)))
    counts[got["piece"].to_numpy(dtype=np.int64), [langs.index(x) for x in got["lang"]]] = got["n"].to_numpy()
    counts = counts[normal] + smoothing
    return Model(langs, [sp.id_to_piece(i) for i in normal], counts / counts.sum(axis=0))


def identify(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred",
             score_col: str = "score") -> DataFrame:
    """``df`` with the predicted language and its posterior probability."""
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.pieces, model.prob))

    @F.pandas_udf("lang string, score double")
    def predicted(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for langs, scores in own.predict(texts[i:j] for texts in map(pd.Series.tolist, it)
                                         for i, j in chunks([t or "" for t in texts])):
            yield pd.DataFrame({"lang": langs, "score": scores})

    hidden = free_name(df, "__langid")
    return (df.withColumn(hidden, predicted(F.col(text_col)))
            .withColumns({lang_col: F.col(f"{hidden}.lang"), score_col: F.col(f"{hidden}.score")}).drop(hidden))
