"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalith.operators import audits, cascade, catalog, first_engine, laptops, matching, reports, scalars, selection
from catalith.sources import queries as source_queries

_ALL = {**scalars.PLANS, **catalog.QUERIES, **matching.QUERIES, **selection.QUERIES, **laptops.QUERIES, **reports.QUERIES, **audits.QUERIES, **first_engine.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan.spark for name, plan in _ALL.items()} | cascade.QUERIES | audits.PIPELINE_QUERIES | source_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: plan.sql() for name, plan in _ALL.items()} | source_queries.oracle_sql()
