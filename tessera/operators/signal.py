"""MFCC means of long ordered signals without gathering a signal in one
task.

Points are numbered per key with the distributed ordinal, each point is
sent to the (at most n_fft / hop) frames that contain it, every frame
(n_fft points) is transformed by a vectorised Arrow UDF (window, power
spectrum, mel bank, dB), and the per-key top-dB clamp, the mean over
frames and the DCT are plain aggregations and array expressions.  Same
maths as ``tessera.functions.media.mfcc_mean`` on the whole signal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from tessera.functions import media as md
from tessera.operators.ordinal import rank_within
from tessera.session import materialize, ship_package


def _frame_db_udf(n_fft: int, sr: int, n_mels: int):
    @pandas_udf(ArrayType(DoubleType()))
    def frame_db(frames: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(f, dtype=np.float64) for f in frames]) if len(frames) else np.zeros((0, n_fft))
        win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
        spec = np.abs(np.fft.rfft(x * win, axis=1)) ** 2
        mel = spec @ md.mel_filterbank(sr, n_fft, n_mels).T
        db = 10.0 * np.log10(np.maximum(mel, 1e-10))
        return pd.Series(list(db))
    return frame_db


def signal_mfcc(points: DataFrame, key: str, order_cols, value_col: str, n_mfcc: int = 13, n_fft: int = 32,
                hop: int = 8, n_mels: int = 20, sr: int = 16000, top_db: float = 80.0,
                normalize: bool = True) -> DataFrame:
    """(key, mfcc) for signals given as one row per point."""
    ship_package(points.sparkSession)
    pts = points.select(F.col(key).alias("_k"), *[F.col(c) for c in order_cols], F.col(value_col).cast("double").alias("_y"))
    pts = rank_within(pts, list(order_cols), ["_k"], rank_col="_pos", size_col="_len")
    if normalize:
        mu = pts.groupBy("_k").agg(F.avg("_y").alias("_mu"))
        pts = pts.join(mu, "_k").withColumn("_y", F.col("_y") - F.col("_mu"))
        amp = pts.groupBy("_k").agg(F.max(F.abs("_y")).alias("_amp"))
        pts = pts.join(amp, "_k").withColumn("_y", F.col("_y") / (F.col("_amp") + F.lit(1e-12)))
    pad = n_fft // 2
    j = F.col("_pos") + pad                                 # index in the zero-padded signal
    n_frames = F.floor(F.col("_len") / hop) + 1             # 1 + (len + 2 pad - n_fft) // hop
    f_lo = F.greatest(F.ceil((j - (n_fft - 1)) / hop), F.lit(0))
    f_hi = F.least(F.floor(j / hop), n_frames - 1)
    framed = (pts.select("_k", "_y", j.alias("_j"), F.explode(F.sequence(f_lo, f_hi)).alias("_f"))
              .withColumn("_o", F.col("_j") - F.col("_f") * hop))
    # every frame that exists, including frames made of padding only
    frames_all = (pts.select("_k", "_len").distinct()
                  .select("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_len") / hop))).alias("_f")))
    grouped = framed.groupBy("_k", "_f").agg(F.map_from_entries(F.collect_list(F.struct("_o", "_y"))).alias("_m"))
    frames = frames_all.join(grouped, ["_k", "_f"], "left").select(
        "_k", "_f", F.transform(F.sequence(F.lit(0), F.lit(n_fft - 1)),
                                lambda i: F.coalesce(F.element_at(F.col("_m"), i.cast("long")), F.lit(0.0))).alias("_x"))
    db = materialize(frames.select("_k", "_f", _frame_db_udf(n_fft, sr, n_mels)(F.col("_x")).alias("_db")))
    peak = db.groupBy("_k").agg(F.max(F.array_max("_db")).alias("_peak"))
    clamped = db.join(peak, "_k").select("_k", F.transform("_db", lambda v: F.greatest(v, F.col("_peak") - top_db)).alias("_db"))
    mean = (clamped.select("_k", F.posexplode("_db").alias("_b", "_v"))
            .groupBy("_k", "_b").agg(F.avg("_v").alias("_v"))
            .groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_b", "_v"))).alias("_mv")))  # n_mels per key
    dct = md.dct_matrix(n_mfcc, n_mels)
    mv = F.transform("_mv", lambda s: s["_v"])
    coef = [F.aggregate(F.zip_with(mv, F.array(*[F.lit(float(c)) for c in row]), lambda a, b: a * b),
                        F.lit(0.0), lambda acc, t: acc + t) for row in dct]
    return mean.select(F.col("_k").alias(key), F.array(*coef).alias("mfcc"))
