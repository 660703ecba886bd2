"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10

_MODULES = (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in getattr(m, "ORACLE_SQL", {}).items()}
