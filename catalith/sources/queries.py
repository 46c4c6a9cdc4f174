"""Registered queries of the readers and writers: tables written to the shared folder and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import text as x
from catalith.functions.dialect import DUCK
from catalith.operators import catalog, reports
from catalith.plans.layers import layered_sql
from catalith.plans.materialize import shared_dir
from catalith.plans.query import Query
from catalith.sources import headers, listings, stores
from catalith.sources.fixtures import CATALOG, INPUT, INPUT_LAYER, inlined


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _from(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{v} AS `{k}`" for k, v in columns.items()))


_LIST = {"manufacturer": INPUT["base_brand"], "Product Name": f"CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE {INPUT['base_name']} END", "Order": "CAST(o_orderkey AS STRING)"}


def s2_csv_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A csv list: header, roles, rows without a name gone."""
    place = _place(spark, "list")
    _from(spark, sf_dir, "orders", _LIST).write.option("header", True).option("escape", '"').csv(place)
    found = next(iter(listings.read_listing(spark, place).values()))
    return found.rows.select(F.col("Order").cast("long").alias("row_id"), F.col(f"`{found.roles.brand}`").alias("brand"), F.col(f"`{found.roles.name}`").alias("name"))


def s11_link_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made from a column of links."""
    rows = _from(spark, sf_dir, "orders", {"Order": "o_orderkey", "url": inlined(INPUT_LAYER["in_url"]), "grade": "'A'"})
    return listings.prepared(rows, "links").rows.select(F.col("Order").alias("row_id"), "product_name")


def s10_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of columns, by their names."""
    lists = [["manufacturer", "name", "type"], ["Brand", "Foxway Product Name ", "Category"], ["id", "product_slug", "product_name", "url"], ["OEM", "Model Number", "Model", "Capacity"], ["DEVICE TYPE", "Make", "Device"], ["type", "grade"], ["price", "Item", "Memory size"]]
    found = [(", ".join(c), r.brand, r.category, r.name, r.storage) for c, r in ((c, headers.roles(c)) for c in lists)]
    return spark.createDataFrame(found, "columns string, brand string, category string, name string, storage string")


_SHEET = {"blank": "CAST(NULL AS STRING)", "category": CATALOG["nl_category"], "brand": CATALOG["nl_brand"], "uae_assetid": CATALOG["uae_assetid"], "uae_assetname": CATALOG["nl_name"]}


def s1_catalog_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's sheet: two title rows and an empty first column go."""
    place = _place(spark, "sheet")
    rows = _from(spark, sf_dir, "part", _SHEET)
    top = spark.createDataFrame([("0", "Catalog", None, None, None), ("1", "category of product", "brand", "id", "name")], "blank string, category string, brand string, uae_assetid string, uae_assetname string").withColumn("blank", F.lit(None).cast("string"))
    top.coalesce(1).write.option("escape", '"').csv(place)
    rows.write.mode("append").option("escape", '"').csv(place)
    titles = [[None, "Catalog", None, None, None], [None, "category of product", "brand", "id", "name"]]
    return listings.read_catalog_sheet(spark, place, titles=titles)


def s12_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean catalog, saved, found and loaded again."""
    place = _place(spark, "reference")
    clean = Query(catalog.clean).spark(spark, sf_dir)
    stores.save_reference(clean, {"final": clean.count()}, place)
    rows, stats = stores.load_reference(spark, place)
    return rows.select("nl_pos", "uae_assetid", "normalized_name").withColumn("n_final", F.lit(stats["final"]).cast("long"))


def s17_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _from(spark, sf_dir, "part", {"uae": "concat(' A', CAST(p_partkey % 900 AS STRING))", "mms": "concat('M', CAST(p_partkey % 1300 AS STRING), ' ')"})
    return stores.load_mapping(pairs, "uae", "mms").select("own", "other_id", F.col("n").alias("n_others"), "status")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query(reports.results).spark(spark, sf_dir)


def s19_result_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each sheet of a written result."""
    place = _place(spark, "result")
    sheets = stores.result_sheets(_results(spark, sf_dir))
    stores.save_results(sheets, place)
    out = None
    for name in sheets:
        rows = spark.read.parquet(f"{place}/{name}").select(F.lit(name).alias("sheet"), "row_id", "match_status")
        out = rows if out is None else out.unionByName(rows)
    return out


def s20_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _place(spark, "diagnostics")
    stores.export_diagnostics(_results(spark, sf_dir).select("row_id", "source_sheet", "match_status", "match_score"), place)
    return stores.load_diagnostics(spark, place).select(F.col("row_id").cast("long").alias("row_id"), "source_sheet", "match_status", F.col("match_score").cast("double").alias("match_score"))


_MISSING = {"Mobile Phone": "5g", "Tablet": "2021"}


def s23_missing_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.missing_products(_results(spark, sf_dir), _MISSING)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (s1_catalog_sheet, s2_csv_list, s10_roles, s11_link_names, s12_reference, s17_mapping, s19_result_sheets, s20_diagnostics, s23_missing_products)}


def _linked() -> str:
    layers = [{"path": x.url_path(DUCK, "url")}, {"name0": x.url_name(DUCK, "path")}, {"product_name": x.clean_url_name(DUCK, "name0")}]
    return f"SELECT row_id, product_name FROM ({layered_sql(f'SELECT o_orderkey AS row_id, {inlined(INPUT_LAYER["in_url"])} AS url FROM orders', layers)}) AS l"


def _sheets() -> str:
    tests = {"Matched": "match_status IN ('MATCHED', 'MULTIPLE_MATCHES')", "Unmatched": "match_status = 'NO_MATCH'", "Review": "match_status = 'REVIEW_REQUIRED'", "Auto-Selected": "auto_selected"}
    rows = Query(reports.results).sql()
    return " UNION ALL ".join(f"SELECT '{n}' AS sheet, row_id, match_status FROM ({rows}) AS r WHERE {t}" for n, t in tests.items())


def _missing() -> str:
    rows = Query(reports.results).sql()
    part = "(SELECT DISTINCT '{0}' AS category, original_input AS uae_assetname FROM ({1}) AS r WHERE match_status = 'NO_MATCH' AND regexp_matches(lower(original_input), '{2}') ORDER BY original_input LIMIT 20)"
    return " UNION ALL ".join(part.format(c, rows, p) for c, p in _MISSING.items())


def oracle_sql() -> dict[str, str]:
    return {
        "s1_catalog_sheet": f"SELECT {', '.join(f'{v} AS {k}' for k, v in _SHEET.items() if k != 'blank')} FROM part",
        "s2_csv_list": f"SELECT o_orderkey AS row_id, {INPUT['base_brand']} AS brand, {INPUT['base_name']} AS name FROM orders WHERE o_orderkey % 50 <> 0",
        "s10_roles": "SELECT * FROM (VALUES ('manufacturer, name, type', 'manufacturer', 'type', 'name', NULL), ('Brand, Foxway Product Name , Category', 'Brand', 'Category', 'Foxway Product Name ', NULL), ('id, product_slug, product_name, url', NULL, NULL, 'product_name', NULL), ('OEM, Model Number, Model, Capacity', 'OEM', NULL, 'Model', 'Capacity'), ('DEVICE TYPE, Make, Device', 'Make', 'DEVICE TYPE', 'Device', NULL), ('type, grade', NULL, 'type', 'grade', NULL), ('price, Item, Memory size', NULL, NULL, 'Item', 'Memory size')) AS v(columns, brand, category, name, storage)",
        "s11_link_names": _linked(),
        "s12_reference": f"SELECT nl_pos, uae_assetid, normalized_name, CAST(count(*) OVER () AS BIGINT) AS n_final FROM ({Query(catalog.clean).sql()}) AS c",
        "s17_mapping": "SELECT concat('A', p_partkey % 900) AS own, min(concat('M', p_partkey % 1300)) AS other_id, count(DISTINCT p_partkey % 1300) AS n_others, CASE WHEN count(DISTINCT p_partkey % 1300) > 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS status FROM part GROUP BY 1",
        "s19_result_sheets": _sheets(),
        "s20_diagnostics": f"SELECT row_id, source_sheet, match_status, match_score FROM ({Query(reports.results).sql()}) AS r",
        "s23_missing_products": _missing(),
    }
