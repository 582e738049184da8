"""Registered queries over the given tables, each with the SQL it must equal."""

from __future__ import annotations

import importlib

MODULES = ["sources", "profiling", "anomalies", "quality", "relations",
           "partitions", "business", "advice", "findings"]


def collect():
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"workload.{name}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
