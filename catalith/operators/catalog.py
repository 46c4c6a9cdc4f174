"""The master catalog: cleaning, lookups and indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions import attributes as a
from catalith.functions import tables as t
from catalith.functions import text as x
from catalith.functions.dialect import SPARK, Dialect
from catalith.plans.layers import once_each
from catalith.plans.query import Query, Table, shared
from catalith.sources.fixtures import CATALOG


def raw(d: Dialect, table: Table) -> str:
    return f"SELECT {', '.join(CATALOG)} FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in CATALOG.items())}, {d.whole} AS whole0 FROM {table('part')}) AS p"


def drop_reason(d: Dialect) -> str:
    """The first filter that a row fails; null for rows that stay."""
    name = "trim(coalesce(nl_name, ''))"
    return d.case(
        (f"{name} = ''", "'null'"),
        (d.has(name, r"(?i)\btest\b"), "'test'"),
        (d.isin("lower(trim(coalesce(nl_brand, '')))", t.PROMO_BRANDS), "'promo'"),
        (d.has(name, r"(?i)\b(?:all\s+(?:models|storage|other|ram)|any\s+(?:storage|brand|model|ram))\b"), "'catchall'"),
        (d.has(name, r"^\d{1,2}$"), "'junk'"),
        other="NULL",
    )


def marked(d: Dialect, table: Table) -> str:
    return f"SELECT *, {drop_reason(d)} AS drop_reason, {d.whole} AS whole1 FROM ({raw(d, table)}) AS r"


@shared("catalog_clean")
def clean(d: Dialect, table: Table) -> str:
    """Rows that stay, with their canonical name and brand."""
    kept = f"SELECT nl_pos, uae_assetid, nl_category, nl_brand, nl_name FROM {d.fence(marked(d, table))} AS m WHERE drop_reason IS NULL AND whole1 >= 0"
    layers = [{"said0": x.match_text(d, "nl_brand", "nl_name")}, {"normalized_name": x.normalize_text(d, "said0")}]
    return once_each(kept, ["nl_brand", "nl_name"], layers, ["normalized_name"])


@shared("catalog_features")
def features(d: Dialect, table: Table) -> str:
    """Clean rows with attributes, storage key and signature."""
    layers = [*a.extract(d, "normalized_name", "nl_brand"), {"storage_key": a.storage_key(d), "signature": a.signature(d)}]
    found = once_each(f"SELECT * FROM {d.fence(clean(d, table))} AS c", ["normalized_name", "nl_brand"], layers, [*a.FIELDS, "storage_key", "signature"])
    return f"SELECT *, {d.whole} AS whole2 FROM ({found}) AS f"


def lookup(d: Dialect, table: Table) -> str:
    return f"SELECT normalized_name, {d.ordered('uae_assetid', 'nl_pos')} AS asset_ids FROM ({clean(d, table)}) AS c GROUP BY normalized_name"


def attribute_index(d: Dialect, table: Table) -> str:
    """One row for each brand, line, model and storage key; watches also stand
    under keys without material, and without connection."""
    base = f"SELECT nl_pos, uae_assetid, normalized_name, brand, product_line, model, storage_key AS own_key, watch_mm, connectivity, material FROM {d.fence(features(d, table))} AS f WHERE model <> '' AND brand <> '' AND whole2 >= 0"
    keys = d.array("own_key", "CASE WHEN product_line = 'watch' AND watch_mm <> '' AND connectivity <> '' AND material <> '' THEN concat(watch_mm, '_', connectivity) ELSE own_key END", "CASE WHEN product_line = 'watch' AND watch_mm <> '' THEN watch_mm ELSE own_key END")
    each = f"SELECT b.*, storage_key FROM (SELECT *, {keys} AS ks FROM ({base}) AS b0) AS b {d.explode('ks', 'storage_key')}"
    return f"SELECT brand, product_line, model, storage_key, {d.ordered('uae_assetid', 'nl_pos')} AS asset_ids, {d.first_by('normalized_name', 'nl_pos')} AS nl_name, min(nl_pos) AS first_pos FROM ({each}) AS e GROUP BY brand, product_line, model, storage_key"


def signature_index(d: Dialect, table: Table) -> str:
    return f"SELECT signature, {d.ordered('uae_assetid', 'nl_pos')} AS asset_ids, {d.first_by('normalized_name', 'nl_pos')} AS nl_name, min(nl_pos) AS first_pos FROM {d.fence(features(d, table))} AS f WHERE signature <> '' AND whole2 >= 0 GROUP BY signature"


def _brand_index(d: Dialect, table: Table) -> str:
    return f"SELECT brand_norm, normalized_name, {d.ordered('uae_assetid', 'nl_pos')} AS asset_ids FROM (SELECT *, {x.normalize_brand(d, 'nl_brand')} AS brand_norm, {d.whole} AS whole3 FROM ({clean(d, table)}) AS c) AS b WHERE brand_norm <> '' AND whole3 >= 0 GROUP BY brand_norm, normalized_name"


def _buckets(d: Dialect, table: Table) -> str:
    return f"SELECT brand, category, CAST(count(DISTINCT normalized_name) AS BIGINT) AS n_names, CAST(count(*) AS BIGINT) AS n_rows FROM {d.fence(features(d, table))} AS f GROUP BY brand, category"


#: Letters of a base by which it is looked up in names, by its length.
_GRAMS = (12, 4, 1)


def custom_config(d: Dialect, source: str) -> str:
    """Names said with 'custom configuration' go if a more specific name contains their base.
    A base is looked up by its first letters at every place of the other names,
    so none is missed; an empty base is in any name."""
    said = f"SELECT nl_pos, nl_name, lower(nl_name) AS low, {d.contains('lower(nl_name)', 'custom configuration')} AS custom FROM ({source}) AS c"
    base = "CASE WHEN contains(low, ' - custom') THEN split_part(nl_name, ' - Custom', 1) ELSE replace(replace(nl_name, 'custom configuration', ''), 'Custom Configuration', '') END"
    length = d.case(*((f"length(base) >= {n}", str(n)) for n in _GRAMS), other="0")
    bases = f"SELECT nl_pos, base, substr(base, 1, {length}) AS gram FROM (SELECT nl_pos, lower(trim({base})) AS base FROM w WHERE custom) AS b0"
    each = " UNION ".join(f"SELECT low, gram FROM o {d.explode(d.each(d.places('low'), lambda i, n=n: f'substr(low, {i}, {n})', 'i'), 'gram')}" for n in _GRAMS)
    grams = f"{each} UNION SELECT min(low) AS low, '' AS gram FROM o HAVING count(*) > 0"
    same = "SELECT DISTINCT b.nl_pos AS gone FROM b JOIN g ON b.gram = g.gram AND contains(g.low, b.base)"
    return f"WITH w AS ({said}), o AS (SELECT DISTINCT low FROM w WHERE NOT custom), b AS ({bases}), g AS ({grams}), s AS ({same}) SELECT w.nl_pos, w.nl_name FROM w LEFT JOIN s ON w.nl_pos = s.gone WHERE s.gone IS NULL"


def specific(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a list without custom configurations that a more specific name covers."""
    view, spark = f"names_{uuid.uuid4().hex}", rows.sparkSession
    rows.select(F.col(f"`{name}`").cast("string").alias("nl_name")).distinct().selectExpr("nl_name AS nl_pos", "nl_name").createOrReplaceTempView(view)
    stay = spark.sql(custom_config(SPARK, f"SELECT nl_pos, nl_name FROM {view}")).select(F.col("nl_name").alias("__stay"))
    spark.catalog.dropTempView(view)
    return rows.join(stay, rows[f"`{name}`"].cast("string") == stay["__stay"], "left_semi")


def _custom_config(d: Dialect, table: Table) -> str:
    """Some names of the fixture are said as custom configurations of their first two words."""
    head = d.ext("nl_name", r"^(\S+ \S+)")
    return custom_config(d, f"SELECT nl_pos, CASE WHEN nl_pos % 7 = 0 THEN concat({head}, ' - Custom configuration') ELSE nl_name END AS nl_name FROM ({clean(d, table)}) AS k")


def _duplicates(d: Dialect, table: Table) -> str:
    """Names under one key of letters and digits with more than one form."""
    keyed = f"SELECT {x.duplicate_key(d, 'nl_name')} AS dup_key, lower(trim(nl_name)) AS form, uae_assetid, nl_pos FROM ({clean(d, table)}) AS c"
    return f"SELECT dup_key, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT form) AS BIGINT) AS n_forms, {d.ordered('uae_assetid', 'nl_pos')} AS asset_ids FROM ({keyed}) AS k GROUP BY dup_key HAVING count(*) > 1"


def _duplicate_marks(d: Dialect, table: Table) -> str:
    return f"SELECT nl_pos, normalized_name, count(*) OVER (PARTITION BY normalized_name) > 1 AS duplicated FROM ({clean(d, table)}) AS c"


def _rebuild_stats(d: Dialect, table: Table) -> str:
    return f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT normalized_name) AS BIGINT) AS n_names, CAST(sum(CASE WHEN duplicated THEN 1 ELSE 0 END) AS BIGINT) AS n_duplicated FROM ({_duplicate_marks(d, table)}) AS m"


def _storage_forms(d: Dialect, table: Table) -> str:
    """Sizes that are written in several ways."""
    raw_forms = d.ext_all("nl_name", r"(?i)(\d+\s*(?:gb|tb))", 1)
    return f"SELECT lower({d.rep('form', ' +', '')}) AS canonical, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT form) AS BIGINT) AS n_forms FROM (SELECT CASE WHEN nl_pos % 2 = 0 THEN lower(nl_name) ELSE replace(nl_name, 'GB', ' GB') END AS nl_name FROM ({clean(d, table)}) AS c) AS q {d.explode(raw_forms, 'form')} GROUP BY lower({d.rep('form', ' +', '')}) HAVING count(DISTINCT form) > 1"


def _spellings(d: Dialect, table: Table) -> str:
    """How often joined and parted spellings occur."""
    pairs = {"pro_max": r"(?i)pro max", "promax": r"(?i)promax", "z_fold": r"(?i)z fold", "zfold": r"(?i)zfold", "galaxy_s_n": r"(?i)galaxy s\d", "tab_s_n": r"(?i)tab s\d", "nth_gen": r"(?i)\dth gen", "gb_joined": r"(?i)\dgb", "gb_parted": r"(?i)\d gb"}
    counts = ", ".join(f"{d.count_if(d.has('nl_name', p))} AS {k}" for k, p in pairs.items())
    return f"SELECT {counts} FROM ({clean(d, table)}) AS c"


def _profile(d: Dialect, table: Table) -> str:
    columns = ("nl_pos", "uae_assetid", "nl_category", "nl_brand", "nl_name")
    parts = [f"SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS n_rows, {d.count_if(f'{c} IS NULL')} AS n_null, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, min(CAST({c} AS STRING)) AS least, max(CAST({c} AS STRING)) AS most FROM ({raw(d, table)}) AS r" for c in columns]
    return " UNION ALL ".join(parts)


def _brand_splits(d: Dialect, table: Table) -> str:
    """Brands said with 'old' or 'new' next to the plain brand."""
    counts = f"SELECT lower(trim(nl_brand)) AS brand, count(*) AS n FROM ({raw(d, table)}) AS r WHERE nl_brand IS NOT NULL GROUP BY lower(trim(nl_brand))"
    based = f"SELECT brand, n, {d.rep('brand', r' (?:old|new|inc\.?|electronics)$', '')} AS base FROM ({counts}) AS c"
    return f"WITH b AS ({based}) SELECT s.brand AS split_brand, s.base, CAST(s.n AS BIGINT) AS n_split, CAST(coalesce(p.n, 0) AS BIGINT) AS n_base FROM b AS s LEFT JOIN b AS p ON p.brand = s.base WHERE s.brand <> s.base"


QUERIES: dict[str, Query] = {
    "s1_raw_catalog": Query(raw),
    "f1_clean": Query(clean),
    "f1_drop_counts": Query(lambda d, t_: f"SELECT coalesce(drop_reason, 'final') AS reason, CAST(count(*) AS BIGINT) AS n FROM ({marked(d, t_)}) AS m GROUP BY coalesce(drop_reason, 'final')"),
    "f1_quality": Query(lambda d, t_: f"SELECT CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_ids, CAST(sum(e) AS BIGINT) AS empty_brands FROM (SELECT uae_assetid, count(*) AS k, sum(CASE WHEN trim(coalesce(nl_brand, '')) = '' THEN 1 ELSE 0 END) AS e FROM ({clean(d, t_)}) AS c GROUP BY uae_assetid) AS g"),
    "f2_custom_config": Query(_custom_config),
    "g1_lookup": Query(lookup),
    "g2_brand_index": Query(_brand_index),
    "g3_attr_index": Query(lambda d, t_: f"SELECT brand, product_line, model, storage_key, asset_ids, nl_name FROM ({attribute_index(d, t_)}) AS i"),
    "g4_sig_index": Query(lambda d, t_: f"SELECT signature, asset_ids, nl_name FROM ({signature_index(d, t_)}) AS i"),
    "g5_buckets": Query(_buckets),
    "g14_breakdown": Query(lambda d, t_: f"SELECT nl_category, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT nl_brand) AS BIGINT) AS n_brands FROM ({clean(d, t_)}) AS c GROUP BY nl_category"),
    "g18_rebuild_stats": Query(_rebuild_stats),
    "g19_duplicates": Query(_duplicates),
    "g20_storage_forms": Query(_storage_forms),
    "g21_spellings": Query(_spellings),
    "g22_profile": Query(_profile),
    "g23_empty_rows": Query(lambda d, t_: f"SELECT CAST(count(*) AS BIGINT) AS n_empty FROM ({raw(d, t_)}) AS r WHERE coalesce(nl_brand, nl_name) IS NULL"),
    "g25_brand_splits": Query(_brand_splits),
    "g26_prefix_stats": Query(lambda d, t_: f"SELECT lower(nl_brand) AS brand, CAST(count(*) AS BIGINT) AS n, {d.count_if(d.starts('lower(nl_name)', 'lower(nl_brand)'))} AS n_prefixed FROM ({clean(d, t_)}) AS c WHERE nl_brand IS NOT NULL GROUP BY lower(nl_brand)"),
    "w6_dup_mark": Query(_duplicate_marks),
    "x2_distinct": Query(lambda d, t_: f"SELECT DISTINCT nl_brand, nl_category FROM ({raw(d, t_)}) AS r"),
}
