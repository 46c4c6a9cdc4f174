"""Choice of one id where a match has several: by what the input says of the product.

Each step keeps the candidates that agree, unless none does.  A step is a flag and
a look at whether any candidate of the input has it, so the whole choice runs on
one partitioning by input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions import attributes as a
from catalith.functions.dialect import SPARK, Dialect
from catalith.operators import catalog, matching
from catalith.plans.layers import Layer, layered_sql
from catalith.plans.materialize import cut
from catalith.plans.query import Query, Table

_KEYS = "query, own_brand, plain"
_MATERIALS = (("aluminum", "alumin"), ("stainless", "stainless"), ("titanium", "titan"), ("ceramic", "ceramic"))


def narrowed(d: Dialect, source: str, tests: list[str], keys: str = _KEYS) -> str:
    """``source`` with ``alive``: whether a row is left after all tests, each of
    which counts only if a row of its group that is left passes it."""
    inner = f"SELECT *, true AS left0 FROM ({source}) AS s"
    for i, test in enumerate(tests):
        told = f"SELECT *, left{i} AND coalesce({test}, false) AS ok{i} FROM ({inner}) AS t"
        seen = f"SELECT *, max(CASE WHEN ok{i} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}) AS any{i} FROM ({told}) AS w"
        inner = f"SELECT *, CASE WHEN any{i} = 1 THEN ok{i} ELSE left{i} END AS left{i + 1} FROM ({seen}) AS k"
    return f"SELECT *, left{len(tests)} AS alive FROM ({inner}) AS n"


def _said(d: Dialect, prefix: str, text: str) -> Layer:
    low = f"lower(coalesce({text}, ''))"
    return {f"{prefix}_{n}": v for n, v in a.variant_keywords(d, text).items()} | {f"{prefix}_5g": d.contains(low, "5g"), f"{prefix}_low": low}


def _layers(d: Dialect) -> list[Layer]:
    return [
        _said(d, "u", "plain") | _said(d, "n", "nl_name"),
        {"u_stem": d.case(*((d.contains("u_low", stem), f"'{stem}'") for _, stem in _MATERIALS)), "u_material": d.case(*((d.contains("u_low", stem), f"'{name}'") for name, stem in _MATERIALS)), "u_year": d.ext("coalesce(plain, '')", r"\b(20\d{2})\b"), "u_4g": f"({d.contains('u_low', '4g')} OR {d.contains('u_low', 'lte')})"},
    ]


#: What a candidate must have, in order.
_TESTS = [
    "u_stem = '' OR contains(n_low, u_stem)",
    "u_year = '' OR contains(nl_name, u_year)",
    "NOT (u_has_fold AND NOT n_has_fold) AND NOT (u_has_flip AND NOT n_has_flip)",
    "(u_fold_gen = '' OR n_fold_gen = u_fold_gen) AND (u_flip_gen = '' OR n_flip_gen = u_flip_gen)",
    "NOT (u_has_pro_max AND NOT n_has_pro_max) AND NOT (u_has_pro AND n_has_pro_max)",
    "NOT u_has_plus OR n_has_plus",
    "u_has_ultra = n_has_ultra",
    "u_has_lite = n_has_lite",
    "u_has_mini = n_has_mini",
]


def choose(d: Dialect, wanted: str, names: str) -> str:
    """``query, own_brand, plain, selected_id, selection_reason, other_ids`` for each
    row of ``wanted`` (those keys and ``ids``, several) by ``names`` (uae_assetid,
    nl_pos, nl_name)."""
    each = f"SELECT w.*, asset_id FROM ({wanted}) AS w {d.explode('w.ids', 'asset_id')}"
    met = f"SELECT e.query, e.own_brand, e.plain, e.ids, e.asset_id, c.nl_pos, c.nl_name FROM ({each}) AS e JOIN ({names}) AS c ON e.asset_id = c.uae_assetid"
    chosen = _picked(d, met, "ids", d.count_if("alive"))
    unknown = "CASE WHEN c.selected_id IS NULL THEN 'Variants not found in catalog' ELSE c.selection_reason END"
    own = d.at("w.ids", 0)
    whole = f"SELECT w.query, w.own_brand, w.plain, w.ids, coalesce(c.selected_id, {own}) AS selected_id, {unknown} AS selection_reason FROM ({wanted}) AS w LEFT JOIN ({chosen}) AS c ON w.query = c.query AND w.own_brand = c.own_brand AND w.plain = c.plain"
    return f"SELECT {_KEYS}, selected_id, selection_reason, {d.keep('ids', lambda e: f'{e} <> selected_id')} AS other_ids FROM ({whole}) AS x"


def _picked(d: Dialect, met: str, of: str, n_left: str) -> str:
    """The choice among the candidates of each text (``met``); ``of`` tells its list, ``n_left`` counts what is alive."""
    left = narrowed(d, layered_sql(met, _layers(d)), _TESTS)
    first = lambda where: f"{d.first_by('asset_id', 'nl_pos')} FILTER (WHERE alive AND {where})"
    flags = ("u_material", "u_year", "u_fold_gen", "u_flip_gen", "u_has_pro_max", "u_has_pro", "u_has_plus", "u_has_ultra", "u_has_lite", "u_has_mini", "u_5g", "u_4g")
    told = f"SELECT {_KEYS}, {of}, {', '.join(f'max({f}) AS {f}' for f in flags)}, {n_left} AS n_left, {first('true')} AS any_id, {first('n_5g')} AS id_5g, {first('NOT n_5g')} AS id_4g FROM ({left}) AS l GROUP BY {_KEYS}, {of}"
    parts = d.array(
        "CASE WHEN u_material <> '' THEN concat('material:', u_material) END", "CASE WHEN u_year <> '' THEN concat('year ', u_year) END", "CASE WHEN u_fold_gen <> '' THEN u_fold_gen WHEN u_flip_gen <> '' THEN u_flip_gen END",
        "CASE WHEN u_has_pro_max THEN 'Pro Max' WHEN u_has_pro THEN 'Pro' END", *(f"CASE WHEN u_has_{w} THEN '{w.title()}' END" for w in ("plus", "ultra", "lite", "mini")),
    )
    matched = d.join(d.keep(parts, lambda e: f"{e} IS NOT NULL"), ", ")
    rules = [
        ("n_left = 1", "any_id", f"CASE WHEN {matched} <> '' THEN concat('Matched ', {matched}) ELSE 'Matched model variant' END"),
        ("u_5g AND id_5g IS NOT NULL", "id_5g", "'Matched 5G (user has 5G)'"),
        ("u_4g AND id_4g IS NOT NULL", "id_4g", "'Matched 4G/LTE (user has 4G/LTE)'"),
        ("id_5g IS NOT NULL AND id_4g IS NOT NULL", "id_4g", "'Defaulted to 4G (user unspecified)'"),
    ]
    picked = d.case(*((when, i) for when, i, _ in rules), other="any_id")
    reason = d.case(*((when, r) for when, _, r in rules), other="'First ID (variants identical)'")
    return f"SELECT {_KEYS}, {of}, {picked} AS selected_id, {reason} AS selection_reason FROM ({told}) AS g"


def choose_named(wanted: DataFrame, held: DataFrame, names: DataFrame) -> DataFrame:
    """``choose`` where many texts share a list of ids: ``wanted`` has a number
    (``list``) in place of ids, ``held`` has ``list, place, asset_id``.  A list is
    taken apart once, and ids of equal names, which the tests cannot tell apart, are
    one candidate with their number.  Gives ``n_ids`` and the first three other ids."""
    spark = wanted.sparkSession
    named = held.join(names, F.col("asset_id") == F.col("uae_assetid")).groupBy("list", "nl_name").agg(F.count("*").alias("n"), F.min_by("asset_id", "nl_pos").alias("asset_id"), F.min("nl_pos").alias("nl_pos"))
    met = wanted.select("query", "own_brand", "plain", "list").join(cut(named), "list")
    view = f"met_{uuid.uuid4().hex}"
    met.createOrReplaceTempView(view)
    chosen = spark.sql(_picked(SPARK, f"SELECT * FROM {view}", "list", "CAST(sum(CASE WHEN alive THEN n ELSE 0 END) AS BIGINT)"))
    spark.catalog.dropTempView(view)
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("r") <= 4, F.struct("r", "asset_id")))), 1, 4)["asset_id"]
    ranked = held.withColumn("r", F.row_number().over(Window.partitionBy("list").orderBy("place")))
    heads = cut(ranked.groupBy("list").agg(F.count("*").alias("n_ids"), first.alias("head")))
    keys = ["query", "own_brand", "plain"]
    whole = wanted.join(heads, "list").join(chosen.select(*keys, F.col("selected_id").alias("picked"), "selection_reason"), keys, "left")
    whole = whole.withColumns({"selected_id": F.coalesce("picked", F.col("head")[0]), "selection_reason": F.when(F.col("picked").isNull(), "Variants not found in catalog").otherwise(F.col("selection_reason"))})
    return whole.withColumn("other_ids", F.slice(F.filter("head", lambda e: e != F.col("selected_id")), 1, 3)).drop("picked", "head")


def multi_id_texts(d: Dialect, table: Table) -> str:
    """Texts whose attributes or signature lead to several ids."""
    exact = matching.text_exact_matches(d, table)
    said = f"SELECT DISTINCT query, own_brand, plain FROM {d.fence(matching.inputs(d, table))} AS i WHERE whole4 >= 0"
    return f"SELECT s.query, s.own_brand, s.plain, {d.split_on('m.mapped_ids', ', ')} AS ids FROM ({said}) AS s JOIN ({exact}) AS m ON s.query = m.query AND s.own_brand = m.own_brand WHERE m.n_ids > 1"


def _select(d: Dialect, table: Table) -> str:
    names = f"SELECT uae_assetid, nl_pos, nl_name FROM {d.fence(catalog.clean(d, table))} AS c"
    inner = choose(d, multi_id_texts(d, table), names)
    return f"SELECT query, own_brand, plain, selected_id, selection_reason, CAST({d.size('other_ids')} AS BIGINT) AS n_other, {d.join(d.slice('other_ids', 3), ', ')} AS first_others FROM ({inner}) AS z"


class _Select(Query):
    """Under Spark each list of ids is taken apart once; DuckDB runs the plain query."""

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        shared = lambda name: Query(lambda d, table: f"SELECT * FROM {table(name)}").spark(spark, sf_dir)
        known, held = matching.known_ids(shared("known_matches"), shared("known_entries"))
        said = shared("input_list").select("query", "own_brand", "plain").distinct()
        wanted = cut(said.join(known.filter("n_ids > 1").select("query", "own_brand", "list"), ["query", "own_brand"]))
        picked = choose_named(wanted, held, shared("catalog_clean").select("uae_assetid", "nl_pos", "nl_name"))
        return picked.select("query", "own_brand", "plain", "selected_id", "selection_reason", (F.col("n_ids") - 1).alias("n_other"), F.array_join("other_ids", ", ").alias("first_others"))


QUERIES: dict[str, Query] = {"d10_select": _Select(_select)}
