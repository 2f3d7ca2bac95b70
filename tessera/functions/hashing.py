"""Deterministic hash randomness shared by split, folds, caps and SMOTE.

h(key, salt) = int(md5(key || ':' || seed || ':' || salt)[0:8], 16), an
integer in [0, 2^32).  The same value is computable in DuckDB as
('0x' || substr(md5(key || ':42:' || salt), 1, 8))::BIGINT, which is what
makes hash-driven operators checkable against SQL.  Ties are always broken
by the row key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
TWO_32 = float(2 ** 32)


def hash_key(key: Column, salt: str | Column, seed: int = SEED) -> Column:
    salt_c = salt if isinstance(salt, Column) else F.lit(str(salt))
    s = F.concat(key.cast("string"), F.lit(f":{seed}:"), salt_c.cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def hash_uniform(key: Column, salt: str | Column, seed: int = SEED) -> Column:
    """Uniform double in [0, 1)."""
    return hash_key(key, salt, seed).cast("double") / F.lit(TWO_32)


def sql_hash(key_sql: str, salt_sql: str, seed: int = SEED) -> str:
    """The DuckDB twin of :func:`hash_key` (used by the oracle SQL)."""
    return (f"('0x' || substr(md5(cast({key_sql} as varchar) || ':{seed}:' || "
            f"cast({salt_sql} as varchar)), 1, 8))::BIGINT")
