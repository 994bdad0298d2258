"""Queries over the given tables and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "scalar_queries",
    "source_queries",
    "history_queries",
    "join_queries",
    "state_queries",
    "text_queries",
    "report_queries",
    "stream_queries",
)


def load_catalog():
    """All registered queries and SQL twins, by name."""
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    from ringside.plans.catalog import ORACLES, QUERIES

    return QUERIES, ORACLES
