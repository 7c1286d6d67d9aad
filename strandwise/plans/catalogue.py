"""The registered queries: name to callable, and name to DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandwise.plans import composites, construction, grounded, history, records, retrieval, scalars, traversal

MODULES = (construction, history, retrieval, traversal, records, composites, scalars, grounded)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: f for m in MODULES for n, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {n: s for m in MODULES for n, s in m.ORACLES.items()}
