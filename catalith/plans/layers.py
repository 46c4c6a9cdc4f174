"""Narrow plans: a table, expressions in layers, and the columns to give."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.dialect import DUCK, SPARK, Dialect

Layer = dict[str, str]
Layers = Callable[[Dialect], list[Layer]]


def apply_layers(df: DataFrame, layers: list[Layer]) -> DataFrame:
    """Each layer's columns over those of the layers below; Catalyst keeps costly
    expressions that are used twice in a projection of their own."""
    for layer in layers:
        df = df.withColumns({name: F.expr(x) for name, x in layer.items()})
    return df


def layered_sql(source: str, layers: list[Layer]) -> str:
    for i, layer in enumerate(layers):
        source = f"SELECT *, {', '.join(f'{x} AS {name}' for name, x in layer.items())} FROM ({source}) AS s{i}"
    return source


def once_each(source: str, keys: list[str], layers: list[Layer], names: list[str]) -> str:
    """``source`` with the columns ``names`` of the layers, computed once for each
    combination of ``keys``, as lists repeat their texts many times."""
    own = [f"k{i}" for i in range(len(keys))]
    each = layered_sql(f"SELECT DISTINCT {', '.join(keys)} FROM ({source}) AS u", layers)
    made = f"SELECT {', '.join([*(f'{k} AS {o}' for k, o in zip(keys, own, strict=True)), *names])} FROM ({each}) AS e"
    same = " AND ".join(f"s.{k} IS NOT DISTINCT FROM f.{o}" for k, o in zip(keys, own, strict=True))
    return f"SELECT s.*, {', '.join(f'f.{n}' for n in names)} FROM ({source}) AS s JOIN ({made}) AS f ON {same}"


@dataclass
class Plan:
    """``source`` names columns of ``table``; both engines read it."""

    table: str
    source: Layer
    layers: Layers
    columns: list[str] = field(default_factory=list)
    where: str = "true"
    #: Columns of the source that the layers read; if given, each combination of them is computed once.
    keys: list[str] = field(default_factory=list)

    def _once(self, source: str, d: Dialect) -> str:
        names = [c for c in self.columns if c not in self.source]
        return f"SELECT {', '.join(self.columns)} FROM ({once_each(source, self.keys, self.layers(d), names)}) AS plan"

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if self.keys:
            source = f"SELECT {', '.join(f'{x} AS {n}' for n, x in self.source.items())} FROM parquet.`{sf_dir}/{self.table}.parquet` WHERE {self.where}"
            return spark.sql(self._once(source, SPARK))
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").filter(self.where).selectExpr(*(f"{x} AS {n}" for n, x in self.source.items()))
        df = apply_layers(df, self.layers(SPARK))
        return df.select(*self.columns) if self.columns else df

    def sql(self) -> str:
        source = f"SELECT {', '.join(f'{x} AS {n}' for n, x in self.source.items())} FROM {self.table} WHERE {self.where}"
        if self.keys:
            return self._once(source, DUCK)
        inner = layered_sql(source, self.layers(DUCK))
        return f"SELECT {', '.join(self.columns) if self.columns else '*'} FROM ({inner}) AS plan"
