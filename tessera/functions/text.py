"""Text helpers for reports, all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capitalize(c: Column) -> Column:
    """First character upper, rest lower (Python ``str.capitalize``; differs
    from ``initcap`` on multi-word strings)."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1 << 30)))


def pad_text(c: Column, width: int) -> Column:
    """Left-justified to ``width`` characters, never truncated (``f"{s:<w}"``)."""
    return F.rpad(c, F.greatest(F.lit(width), F.length(c)), " ")


def format_fixed(c: Column, decimals: int) -> Column:
    """``'%.{d}f' % v``: ``format_number`` rounds the exact binary value
    half-to-even like printf; its grouping commas are removed."""
    return F.replace(F.format_number(c, decimals), F.lit(","), F.lit(""))


def format_percent(c: Column, decimals: int = 1) -> Column:
    return F.concat(format_fixed(c, decimals), F.lit("%"))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, with 0/0 and x/0 giving ``default`` (no ANSI error)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))
