"""Lists of products: one csv file, or a folder with a csv file for each sheet.

A file is read as text columns.  The names of the columns stand in one of the
first rows; titles above it are no data.  Rows are told from titles and headers
by their cells, not by their place, so a file can be read in parts by many tasks.

Edge cases: a file without columns gives no list; rows whose name is null go;
links that give too few names leave the column of names as it is; columns whose
names repeat get their place as a suffix.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.functions import text as x
from catalith.functions.dialect import SPARK
from catalith.operators.catalog import specific
from catalith.plans.layers import apply_layers
from catalith.plans.materialize import cut
from catalith.sources import headers
from catalith.sources.headers import Roles

#: Share of rows whose link must give a name, for links to be the source of names.
LINK_SHARE = 0.5


@dataclass
class Listing:
    sheet: str
    rows: DataFrame
    roles: Roles


def _apart(names: Sequence[str]) -> list[str]:
    """Names that are all different, as columns of a table must be."""
    seen: set[str] = set()
    out = []
    for i, n in enumerate(names):
        name = n or f"col_{i}"
        out.append(f"{name}_{i}" if name.lower() in seen else name)
        seen.add(out[-1].lower())
    return out


def _top_rows(spark: SparkSession, path: str) -> list[list[str | None]]:
    """Cells of the first rows; a few lines of the file's head come to the driver."""
    lines = [r.value for r in spark.read.text(path).filter("trim(value) <> ''").limit(headers.HEADER_ROWS).collect()]
    return [[c if c != "" else None for c in row] for row in csv.reader(lines)]


def _same_cells(columns: Sequence[str], cells: Sequence[str | None]) -> Column:
    test = F.lit(True)
    for c, v in zip(columns, cells, strict=False):
        test = test & F.col(f"`{c}`").eqNullSafe(F.lit(v))
    return test


def read_sheet(spark: SparkSession, path: str, sheet: str, first_row_is_header: bool = False) -> Listing | None:
    """The list of one csv file, with the roles of its columns."""
    top = _top_rows(spark, path)
    if not top:
        return None
    at = 0 if first_row_is_header else min(headers.header_row(top), len(top) - 1)
    width = max(map(len, top))
    names, skip = headers.headers(top[at], width)
    names = _apart(names)
    if not names:
        return None
    raw = [f"_{i}" for i in range(width)]
    cells = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in raw])).option("quote", '"').option("escape", '"').option("multiLine", False).csv(path)
    for row in top[: at + 1]:
        cells = cells.filter(~_same_cells(raw, [*row, *[None] * (width - len(row))]))
    rows = cells.select(*(F.col(c).alias(n) for c, n in zip(raw[skip:], names, strict=True)))
    return prepared(rows, sheet)


def prepared(rows: DataFrame, sheet: str) -> Listing | None:
    """Roles, names from links, and without rows that are no product."""
    found = headers.roles(rows.columns)
    link = headers.url_column(rows.columns)
    if link:
        rows, from_links = names_from_links(rows, link)
        if from_links:
            found = Roles(found.brand, found.category, "product_name", found.storage)
    if found.name is None:
        return None
    rows = rows.filter(F.col(f"`{found.name}`").isNotNull())
    return Listing(sheet, specific(rows, found.name), found)


def names_from_links(rows: DataFrame, link: str, share: float = LINK_SHARE) -> tuple[DataFrame, bool]:
    """``product_name`` made from links, if enough rows get one; else the rows as they are."""
    own = [c for c in rows.columns if c != "product_name"]
    layers = [{"__path": x.url_path(SPARK, f"`{link}`")}, {"__name": x.url_name(SPARK, "__path")}, {"product_name": x.clean_url_name(SPARK, "__name")}]
    links = apply_layers(rows.select(f"`{link}`").distinct(), layers).select(F.col(f"`{link}`").alias("__link"), "product_name")
    kept = rows.select(*(f"`{c}`" for c in own))
    made = cut(kept.join(links, kept[f"`{link}`"].eqNullSafe(links["__link"])).drop("__link"), "links")
    said = made.agg(F.count("*").alias("n"), F.count_if(F.trim("product_name") != "").alias("named")).first()
    enough = said["named"] >= share * said["n"]
    return (made, True) if enough else (rows, False)


def read_listing(spark: SparkSession, path: str) -> dict[str, Listing]:
    """A single csv file, named by its file name."""
    sheet = path.rstrip("/").split("/")[-1].rsplit(".", 1)[0]
    found = read_sheet(spark, path, sheet, first_row_is_header=True)
    return {sheet: found} if found else {}


def read_workbook(spark: SparkSession, folder: str, catalog_words: Sequence[str] = headers.t.CATALOG_SHEETS) -> dict[str, Listing]:
    """A csv file for each sheet; sheets of the catalog are passed over."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = sorted(s.getPath().toString() for s in store.listStatus(where) if s.getPath().getName().endswith(".csv"))
    out = {}
    for path in paths:
        sheet = path.split("/")[-1].rsplit(".", 1)[0]
        found = None if headers.is_catalog_sheet(sheet, catalog_words) else read_sheet(spark, path, sheet)
        if found:
            out[sheet] = found
    return out


def read_catalog_sheet(spark: SparkSession, path: str, skip_rows: int = 2, titles: Sequence[Sequence[str | None]] | None = None) -> DataFrame:
    """The catalog: title rows, an empty first column, then four columns with fixed
    names.  The titles are the first rows of a single file unless they are given."""
    top = _top_rows(spark, path)[:skip_rows] if titles is None else titles
    width = 5
    raw = [f"_{i}" for i in range(width)]
    cells = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in raw])).option("escape", '"').csv(path)
    for row in top:
        cells = cells.filter(~_same_cells(raw, [*row, *[None] * (width - len(row))][:width]))
    return cells.select(*(F.col(c).alias(n) for c, n in zip(raw[1:], ("category", "brand", "uae_assetid", "uae_assetname"), strict=True)))
