"""Array (vector / image-grid) functions built from Spark higher-order
functions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Per-channel normalisation of 3-channel images (ImageNet
# statistics used with pretrained image encoders).
CHANNEL_MEAN = [0.485, 0.456, 0.406]
CHANNEL_STD = [0.229, 0.224, 0.225]

# ITU-R 601-2 luma weights for RGB -> gray (L = R*299/1000 +
# G*587/1000 + B*114/1000).
LUMA_WEIGHTS = (299, 587, 114)


def to_double(arr: Column) -> Column:
    return arr.cast("array<double>")


def round_array(arr: Column, digits: int = 6) -> Column:
    return F.transform(arr, lambda x: F.round(x, digits) + F.lit(0.0))


def slice0(arr: Column, start: int, length: int | Column | None = None) -> Column:
    """0-based [start, start+length) slice; length None = to the end."""
    if length is None:
        length = F.size(arr) - start
    return F.slice(arr, start + 1, length)


def array_to_columns(df: DataFrame, vec: str, prefix: str, width: int | None = None) -> DataFrame:
    """``vec`` spread over columns prefix0, prefix1, ..., as many as its longest
    array has elements (or ``width``); shorter arrays give nulls."""
    width = width if width is not None else df.agg(F.max(F.size(vec))).first()[0] or 0
    return df.select(*[c for c in df.columns if c != vec], *[F.get(vec, F.lit(i)).alias(f"{prefix}{i}") for i in range(max(width, 0))])


def slice_modalities(arr: Column, widths) -> list[Column]:
    """Cut a fused vector back into consecutive parts; the last width may
    be None (= the rest)."""
    out, start = [], 0
    for w in widths:
        out.append(slice0(arr, start, w))
        if w is not None:
            start += w
    return out


def reshape_grid(arr: Column, h: int, w: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: F.slice(arr, r * w + 1, w))


def flatten_grid(grid: Column) -> Column:
    return F.flatten(grid)


def pool_grid(arr: Column, h: int, w: int, k: int = 2) -> Column:
    """k x k block mean of a row-major h x w grid, row-major (h/k) x (w/k) result."""
    ow = w // k
    n = (h // k) * ow

    def cell(i):
        r0 = (i / ow).cast("int") * k
        c0 = (i % ow) * k
        s = None
        for dr in range(k):
            for dc in range(k):
                v = F.element_at(arr, (r0 + dr) * w + c0 + dc + 1).cast("double")
                s = v if s is None else s + v
        return s / F.lit(float(k * k))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell)


def grayscale(arr: Column, plane: int) -> Column:
    """Planar RGB (R plane, G plane, B plane; ``plane`` values each) -> gray."""
    wr, wg, wb = LUMA_WEIGHTS

    def px(i):
        r = F.element_at(arr, i + 1).cast("double")
        g = F.element_at(arr, i + 1 + plane).cast("double")
        b = F.element_at(arr, i + 1 + 2 * plane).cast("double")
        return (F.lit(float(wr)) * r + F.lit(float(wg)) * g + F.lit(float(wb)) * b) / F.lit(1000.0)

    return F.transform(F.sequence(F.lit(0), F.lit(plane - 1)), px)


def replicate_channels(arr: Column, n: int = 3) -> Column:
    return F.flatten(F.array_repeat(arr, n))


def normalize_channels(arr: Column, plane: Column | int, mean=CHANNEL_MEAN, std=CHANNEL_STD) -> Column:
    """(x / 255 - mean_c) / std_c where c = position div plane size."""
    m = F.array(*[F.lit(float(x)) for x in mean])
    s = F.array(*[F.lit(float(x)) for x in std])
    p = plane if isinstance(plane, Column) else F.lit(plane)
    return F.transform(arr, lambda x, i: (x.cast("double") / 255.0 - F.element_at(m, (i / p).cast("int") + 1))
                       / F.element_at(s, (i / p).cast("int") + 1))


def flip_rows(arr: Column, h: int, w: int) -> Column:
    """Horizontal mirror of a row-major h x w grid."""
    return F.flatten(F.transform(reshape_grid(arr, h, w), lambda row: F.reverse(row)))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)
