"""Registry of query keys: each key is a Spark query (spark, sf_dir) ->
DataFrame, and optionally the equivalent DuckDB SQL used as the oracle."""

from __future__ import annotations

from collections.abc import Callable

from corvid.sources.views import with_views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def key(name: str, sql: str | None = None, views: bool = True):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate key {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql) if views else sql
        return fn
    return deco


def load_all() -> None:
    """Import every key module (registration happens at import)."""
    from corvid.keys import (  # noqa: F401
        k_sources, k_select, k_profile, k_prep, k_evaluate, k_rank, k_models, k_neighbors,
        k_explain, k_stream)
