"""Positional alignment and fusion of modalities.

The reference pairs the i-th sorted file of each modality with the i-th
table row.  Here each source gets a distributed ordinal (``rank_within``),
sources meet in an inner equi-join on it (which also cuts to the shortest),
and the source keys stay as lineage columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordinal import rank_within


def with_ordinal(df: DataFrame, order_cols, col: str = "ordinal") -> DataFrame:
    return rank_within(df, order_cols, [], rank_col=col)


def align_by_position(sources: dict[str, tuple[DataFrame, list]], col: str = "ordinal") -> DataFrame:
    """sources: name -> (frame, order columns).  Every frame's columns are
    prefixed with its name; the result has one row per ordinal present in
    all sources.  The order columns must identify a row of their source."""
    # only the order keys are ranked; the narrow ranks meet, which cuts every
    # source to the shortest, and the wide columns join the kept keys once
    ranks = []
    for name, (df, order) in sources.items():
        r = with_ordinal(df.select(*order), order, col)
        ranks.append(r.select(col, *[F.col(c).alias(f"_{name}_{c}") for c in order]))
    out = reduce(lambda a, b: a.join(b, col, "inner"), ranks)
    for name, (df, order) in sources.items():
        wide = df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])
        cond = reduce(lambda a, b: a & b, [F.col(f"_{name}_{c}").eqNullSafe(F.col(f"{name}_{c}")) for c in order])
        out = out.join(wide, cond, "inner").drop(*[f"_{name}_{c}" for c in order])
    return out


def head_n(df: DataFrame, order_cols, n: int, col: str = "ordinal") -> DataFrame:
    return with_ordinal(df, order_cols, col).where(F.col(col) < n)


class Layout:
    """A named order of modality parts in a fused vector, e.g.
    ``Layout([("tab", 21), ("aud", 13), ("img", None)])``; the last width
    may be ``None`` (the rest).  ``fuse`` concatenates array columns in this
    order; ``parts`` cuts a fused vector back into named parts."""

    def __init__(self, parts):
        self.parts = [(name, width) for name, width in parts]
        if any(w is None for _, w in self.parts[:-1]):
            raise ValueError("only the last part may have an open width")

    @property
    def names(self):
        return [n for n, _ in self.parts]

    def fuse(self, **arrays) -> F.Column:
        missing = [n for n in self.names if n not in arrays]
        if missing:
            raise KeyError(f"missing parts: {missing}")
        return F.concat(*[arrays[n].cast("array<double>") for n in self.names])

    def parts_of(self, vec) -> dict:
        from tessera.functions.arrays import slice_modalities
        cols = slice_modalities(vec, [w for _, w in self.parts])
        return dict(zip(self.names, cols))


# Layouts of the reference's two fused vectors: tabular -> audio -> image
# pixels, and image embedding -> audio -> tabular.
TAB_AUD_IMG = Layout([("tab", 21), ("aud", 13), ("img", None)])
IMG_AUD_TAB = Layout([("img", 512), ("aud", 13), ("tab", None)])
