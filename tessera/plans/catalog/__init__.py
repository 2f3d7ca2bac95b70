"""Registry of named queries (one per operator of the survey inventory).

Each entry is a callable ``(spark, sf_dir) -> DataFrame``; ``ORACLE`` holds
the DuckDB SQL of the entries whose values can be checked in SQL.
"""

from __future__ import annotations

from tessera.plans.catalog.registry import QUERIES, ORACLE  # noqa: F401
from tessera.plans.catalog import (  # noqa: F401
    profile_queries, prep_queries, metric_queries, score_queries, fusion_queries, balance_queries, io_queries, stream_queries, model_queries, media_queries,
)
