"""Where catalogs, mappings and results are kept.

A store is a folder with parquet data and a json file of statistics; a result is
a folder with one part for each sheet or report.  All paths go through Spark's
own file systems.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DATA, _META = "clean.parquet", "meta.json"


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, text: str, *parts: str) -> None:
    path, store = _path(spark, *parts)
    out = store.create(path, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def _read_text(spark: SparkSession, *parts: str) -> str:
    path, store = _path(spark, *parts)
    stream = store.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def save_reference(catalog: DataFrame, stats: dict, folder: str) -> None:
    """Text columns are written as text whatever they hold; the statistics come last."""
    spark = catalog.sparkSession
    catalog.write.mode("overwrite").parquet(f"{folder}/{_DATA}")
    _write_text(spark, json.dumps(stats, indent=2, default=str), folder, _META)


def reference_exists(spark: SparkSession, folder: str) -> bool:
    return all(store.exists(path) for path, store in (_path(spark, folder, f"{_DATA}/_SUCCESS"), _path(spark, folder, _META)))


def load_reference(spark: SparkSession, folder: str) -> tuple[DataFrame, dict] | None:
    """The catalog and its statistics, or None if either is missing."""
    if not reference_exists(spark, folder):
        return None
    return spark.read.parquet(f"{folder}/{_DATA}"), json.loads(_read_text(spark, folder, _META))


def delete_reference(spark: SparkSession, folder: str) -> None:
    for name in (_META, _DATA):
        path, store = _path(spark, folder, name)
        store.delete(path, True)


def load_mapping(rows: DataFrame, own: str, other: str) -> DataFrame:
    """Of each id its counterparts in another catalog: the first, whether it is the only one, and all."""
    pairs = rows.select(F.trim(F.col(own).cast("string")).alias("own"), F.trim(F.col(other).cast("string")).alias("other")).filter("own <> '' AND other <> ''").distinct()
    return pairs.groupBy("own").agg(F.count("*").alias("n"), F.min("other").alias("other_id"), F.array_sort(F.collect_list("other")).alias("others")).withColumn("status", F.when(F.col("n") > 1, "AMBIGUOUS").otherwise("FOUND"))


def save_results(sheets: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """A folder for each sheet of a result."""
    for name, rows in sheets.items():
        out = rows.write.mode("overwrite")
        if kind == "csv":
            out.option("header", True).csv(f"{folder}/{name}")
        else:
            out.parquet(f"{folder}/{name}")


def result_sheets(results: DataFrame, summary: DataFrame | None = None) -> dict[str, DataFrame]:
    """Matched, unmatched and review rows, those that were selected among several, and the summary."""
    status = F.col("match_status")
    out = {
        "Matched": results.filter(status.isin("MATCHED", "MULTIPLE_MATCHES")),
        "Unmatched": results.filter(status == "NO_MATCH"),
        "Review": results.filter(status == "REVIEW_REQUIRED").orderBy(F.desc("review_priority"), "row_id"),
        "Auto-Selected": results.filter("auto_selected"),
    }
    return out | ({"Summary": summary} if summary is not None else {})


def export_diagnostics(rows: DataFrame, folder: str, sheet_col: str = "source_sheet") -> None:
    """All rows in one report, and a part for each sheet."""
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/All Combined")
    rows.withColumn("sheet", F.col(sheet_col)).write.mode("overwrite").partitionBy("sheet").option("header", True).csv(f"{folder}/by_sheet")


def load_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """The combined report, or the first part that there is."""
    path, store = _path(spark, folder, "All Combined")
    if store.exists(path):
        return spark.read.option("header", True).csv(path.toString())
    where, _ = _path(spark, folder)
    names = sorted(s.getPath().toString() for s in store.listStatus(where) if s.isDirectory())
    return spark.read.option("header", True).csv(names[0])


def sample_template(spark: SparkSession) -> DataFrame:
    """Rows that show what an input list looks like."""
    rows = [("Apple", "iPhone 14 Pro 128GB", "Mobile Phone"), ("Samsung", "Galaxy S23 Ultra 256GB", "Mobile Phone"), ("Apple", "iPad Air 5th Gen 64GB", "Tablet"), ("Apple", "Watch Series 8 45mm GPS", "Smartwatch"), ("Dell", "Latitude 5420 Core i5 16GB 512GB", "Laptop")]
    return spark.createDataFrame(rows, "manufacturer string, product_name string, category string")


def missing_products(results: DataFrame, patterns: dict[str, str], limit: int = 20) -> DataFrame:
    """Names of rows without a match that fit a pattern, at most ``limit`` for each
    pattern, as rows to add to a catalog: the limit is the report's."""
    parts = []
    for category, pattern in patterns.items():
        names = results.filter((F.col("match_status") == "NO_MATCH") & F.lower("original_input").rlike(pattern)).select("original_input").distinct().orderBy("original_input").limit(limit)
        parts.append(names.select(F.lit(category).alias("category"), F.col("original_input").alias("uae_assetname")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
