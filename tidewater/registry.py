"""Queries of the reference's operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PLANS = ("retrieval", "indexing", "store_queries", "event_queries", "text_queries", "stream_queries")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _name in PLANS:
    _plan = import_module(f"tidewater.plans.{_name}")
    QUERIES |= _plan.QUERIES
    SQL |= _plan.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: BM25 and exact vectors, fused by rank and grouped by file."""
    return QUERIES["rrf_hybrid"](spark, sf_dir)
