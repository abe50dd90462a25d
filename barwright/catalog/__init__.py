"""Registered queries with their SQL twins, grouped like the operators."""

from __future__ import annotations

from barwright.catalog import bar_queries, drift_queries, metric_queries, model_queries, table_queries
from barwright.catalog.inputs import Entry

MODULES = (table_queries, bar_queries, drift_queries, metric_queries, model_queries)


def entries() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    for module in MODULES:
        for name, entry in module.REGISTRY.items():
            if name in out:
                raise ValueError(f"duplicate query {name}")
            out[name] = entry
    return dict(sorted(out.items()))
