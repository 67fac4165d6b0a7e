"""All registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memlake.plans import facts, graphs, memories, records, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (memories, vectors, graphs, facts, records):
    QUERIES |= {name: query for name, (query, _) in _part.PLANS.items()}
    ORACLES |= {name: sql for name, (_, sql) in _part.PLANS.items() if sql}
