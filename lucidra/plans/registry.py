"""All registered queries of the core, by name."""

from __future__ import annotations

from lucidra.plans import domain_queries, metric_queries, orphan_queries, shred_queries

_MODULES = [metric_queries, domain_queries, orphan_queries, shred_queries]


def queries() -> dict:
    """Name -> callable(spark, data directory)."""
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    """Name -> SQL for DuckDB."""
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
