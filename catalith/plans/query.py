"""Whole queries as SQL text, built for either dialect."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from catalith.functions.dialect import DUCK, SPARK, Dialect
from catalith.plans import materialize

Table = Callable[[str], str]
#: Intermediate results that queries share, by name: how to write them.
SHARED: dict[str, Callable[[Dialect, Table], str]] = {}


def shared(name: str) -> Callable:
    """Under Spark a shared result is computed once a session for a state of the
    files it comes from, and written to the shared folder; it also keeps
    predicates and projections above it from being folded into its many layers,
    and later plans small.  DuckDB gets it as a materialized table of
    the query."""

    def mark(build: Callable[[Dialect, Table], str]) -> Callable[[Dialect, Table], str]:
        SHARED[name] = build
        return lambda d, table: f"SELECT * FROM {table(name)}"

    return mark


@dataclass
class Query:
    """``build`` writes the query from the dialect and the name of a table."""

    build: Callable[[Dialect, Table], str]

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        files = materialize.state(spark, [f"{sf_dir}/{t}.parquet" for t in ("orders", "part")])
        mark = hashlib.md5(f"{sf_dir}\n{files}".encode()).hexdigest()[:12]

        def table(name: str) -> str:
            if name not in SHARED:
                return f"parquet.`{sf_dir}/{name}.parquet`"
            view = f"{name}_{mark}"
            if not spark.catalog.tableExists(view):
                materialize.cut(spark.sql(SHARED[name](SPARK, table)), name).createOrReplaceTempView(view)
            return view

        return spark.sql(self.build(SPARK, table))

    def sql(self) -> str:
        used: dict[str, str] = {}

        def table(name: str) -> str:
            if name in SHARED and name not in used:
                text = SHARED[name](DUCK, table)  # first the ones that it reads
                used[name] = text
            return name

        body = self.build(DUCK, table)
        first = ", ".join(f"{n} AS MATERIALIZED ({text})" for n, text in used.items())
        return f"WITH {first} SELECT * FROM ({body}) AS answer" if first else body
