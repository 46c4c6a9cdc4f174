"""Joins of the input list with the catalog, and the gates on pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import attributes as a
from catalith.functions import families
from catalith.functions import tables as t
from catalith.functions import text as x
from catalith.functions.dialect import Dialect
from catalith.operators import catalog
from catalith.plans.layers import Layer, layered_sql, once_each
from catalith.plans.materialize import cut
from catalith.plans.query import Query, Table, shared
from catalith.sources.fixtures import INPUT, INPUT_LAYER


@shared("input_list")
def inputs(d: Dialect, table: Table) -> str:
    """Input rows with canonical brand and the text that is looked for."""
    raw = f"SELECT {', '.join(f'{v} AS {k}' for k, v in INPUT.items())} FROM {table('orders')}"
    listed = layered_sql(raw, [INPUT_LAYER])
    own = {"own_brand": d.either(x.normalize_brand(d, "in_brand"), x.infer_brand(d, "in_name")), "plain": x.strip_colours(d, "in_name")}
    found = once_each(listed, ["in_brand", "in_name"], [own, {"said1": x.match_text(d, "own_brand", "plain")}, {"query": x.normalize_text(d, "said1")}], ["own_brand", "plain", "query"])
    return f"SELECT *, {d.whole} AS whole4 FROM ({found}) AS i"


#: What is known of each distinct text.
TEXT_FIELDS = [*a.FIELDS, "storage_key", "signature", "asks_laptop"]


@shared("input_texts")
def texts(d: Dialect, table: Table) -> str:
    """Each distinct text of the input list with its attributes; lists repeat their texts many times."""
    layers = [*a.extract(d, "query", "own_brand"), {"storage_key": a.storage_key(d), "signature": a.signature(d), "asks_laptop": a.is_laptop(d, "query")}]
    each = layered_sql(f"SELECT DISTINCT query, own_brand FROM {d.fence(inputs(d, table))} AS i WHERE whole4 >= 0", layers)
    return f"SELECT query, own_brand, {', '.join(TEXT_FIELDS)}, {d.whole} AS whole6 FROM ({each}) AS t"


@shared("input_features")
def input_features(d: Dialect, table: Table) -> str:
    kept = f"SELECT row_id, source_sheet, in_brand, in_name, in_category, own_brand, query FROM {d.fence(inputs(d, table))} AS i WHERE whole4 >= 0"
    known = f"SELECT query AS t_query, own_brand AS t_brand, {', '.join(TEXT_FIELDS)} FROM {d.fence(texts(d, table))} AS t WHERE whole6 >= 0"
    return f"SELECT i.*, {', '.join(f't.{n}' for n in TEXT_FIELDS)}, {d.whole} AS whole5 FROM ({kept}) AS i JOIN ({known}) AS t ON i.query = t.t_query AND i.own_brand = t.t_brand"


def index_rows(d: Dialect, table: Table) -> str:
    """The attribute index with the first name's category."""
    return f"SELECT *, {a.category(d, 'nl_name')} AS nl_category FROM ({catalog.attribute_index(d, table)}) AS i"


def _rows(d: Dialect, table: Table, found: str, columns: str) -> str:
    """What was found for a text, for each of its rows."""
    return f"SELECT r.row_id, {columns} FROM (SELECT row_id, query, own_brand FROM {d.fence(inputs(d, table))} AS i WHERE whole4 >= 0) AS r JOIN ({found}) AS m ON r.query = m.query AND r.own_brand = m.own_brand"


_FOUND = "mapped_ids, n_ids, matched_on, method, match_score"


def text_attribute_matches(d: Dialect, table: Table, index: str = "") -> str:
    """Equal brand, line and model; then the best of the ways in which storage keys
    may agree.  Ids stay in their lists until the way is chosen."""
    plain_watch = "q.product_line = 'watch' AND q.watch_mm <> '' AND q.material = ''"
    tier = d.case(
        ("i.storage_key = q.storage_key", "1"),
        (f"{plain_watch} AND q.connectivity <> '' AND i.storage_key = concat(q.watch_mm, '_', q.connectivity)", "2"),
        (f"{plain_watch} AND i.storage_key = q.watch_mm", "3"),
        ("q.ram <> '' AND q.product_line <> 'watch' AND i.storage_key = q.storage", "4"),
        ("i.storage_key = '' AND NOT (q.product_line = 'watch' AND q.watch_mm <> '' AND q.material <> '')", "5"),
        ("q.storage = '' AND q.product_line <> 'watch'", "6"),
        other="NULL",
    )
    met = f"SELECT q.query, q.own_brand, q.category, i.asset_ids, i.nl_name, i.nl_category, i.first_pos, i.storage_key AS k, {tier} AS tier FROM {d.fence(texts(d, table))} AS q JOIN ({index or index_rows(d, table)}) AS i ON q.brand = i.brand AND q.product_line = i.product_line AND q.model = i.model WHERE q.model <> '' AND q.whole6 >= 0"
    best = f"SELECT *, min(tier) OVER (PARTITION BY query, own_brand) AS best FROM ({met}) AS m WHERE tier IS NOT NULL"
    grouped = f"SELECT query, own_brand, min(tier) AS tier, {d.distinct(d.flat('asset_ids', 'first_pos'))} AS ids, {d.first_by('nl_name', 'first_pos')} AS matched_on, {d.first_by('nl_category', 'first_pos')} AS nl_category, min(category) AS category, count(*) AS n_keys FROM ({best}) AS b WHERE tier = best GROUP BY query, own_brand"
    method = d.case(("tier IN (2, 3)", "'attribute_watch_fallback'"), ("tier = 6 AND n_keys = 1", "'attribute_tier2_single_variant'"), ("tier = 6", "'attribute_tier2_multi_variant'"), (f"{d.size('ids')} > 1", "'attribute_auto_selected'"), other="'attribute'")
    score = "CASE WHEN tier = 1 THEN 100.0 WHEN tier IN (2, 3, 4) OR (tier = 6 AND n_keys = 1) THEN 95.0 ELSE 90.0 END"
    return f"SELECT query, own_brand, {d.join('ids', ', ')} AS mapped_ids, CAST({d.size('ids')} AS BIGINT) AS n_ids, matched_on, {method} AS method, CAST({score} AS DOUBLE) AS match_score FROM ({grouped}) AS g WHERE category = 'other' OR category = nl_category"


def attribute_matches(d: Dialect, table: Table) -> str:
    return _rows(d, table, text_attribute_matches(d, table), _FOUND)


def text_signature_matches(d: Dialect, table: Table, index: str = "") -> str:
    index = index or f"SELECT *, {a.category(d, 'nl_name')} AS nl_category FROM ({catalog.signature_index(d, table)}) AS i"
    return f"SELECT q.query, q.own_brand, {d.join('i.asset_ids', ', ')} AS mapped_ids, CAST({d.size('i.asset_ids')} AS BIGINT) AS n_ids, i.nl_name AS matched_on, 'signature' AS method, CAST(100 AS DOUBLE) AS match_score FROM {d.fence(texts(d, table))} AS q JOIN ({index}) AS i ON q.signature = i.signature WHERE q.signature <> '' AND q.whole6 >= 0 AND (q.category = 'other' OR q.category = i.nl_category)"


@shared("exact_matches")
def text_exact_matches(d: Dialect, table: Table) -> str:
    """By attributes, else by signature."""
    return _either(text_attribute_matches(d, table), text_signature_matches(d, table))


def _either(by_attributes: str, by_signature: str) -> str:
    both = f"SELECT *, 0 AS turn FROM ({by_attributes}) AS a UNION ALL SELECT *, 1 AS turn FROM ({by_signature}) AS s"
    first = f"SELECT *, min(turn) OVER (PARTITION BY query, own_brand) AS best FROM ({both}) AS b"
    return f"SELECT query, own_brand, {_FOUND} FROM ({first}) AS f WHERE turn = best"


@shared("known_entries")
def known_entries(d: Dialect, table: Table) -> str:
    """Entries of both indexes, each under a name of its own; a list of ids grows
    with the catalog, and texts that lead to it are many."""
    by_attributes = f"SELECT concat('a', sha2(concat_ws('|', brand, product_line, model, storage_key), 256)) AS entry, brand, product_line, model, storage_key, '' AS signature, asset_ids, nl_name, nl_category, first_pos FROM ({index_rows(d, table)}) AS i"
    by_signature = f"SELECT concat('s', sha2(signature, 256)) AS entry, '' AS brand, '' AS product_line, '' AS model, '' AS storage_key, signature, asset_ids, nl_name, {a.category(d, 'nl_name')} AS nl_category, first_pos FROM ({catalog.signature_index(d, table)}) AS s"
    return f"{by_attributes} UNION ALL {by_signature}"


@shared("known_matches")
def known_matches(d: Dialect, table: Table) -> str:
    """``text_exact_matches`` with the names of entries in place of their ids."""
    return _either(known_by_attributes(d, table), known_by_signature(d, table))


def _named(table: Table, start: str) -> str:
    return f"SELECT brand, product_line, model, storage_key, signature, array(entry) AS asset_ids, nl_name, nl_category, first_pos FROM {table('known_entries')} WHERE startswith(entry, '{start}')"


def known_by_attributes(d: Dialect, table: Table) -> str:
    return text_attribute_matches(d, table, _named(table, "a"))


def known_by_signature(d: Dialect, table: Table) -> str:
    return text_signature_matches(d, table, _named(table, "s"))


def known_ids(found: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches that name entries (``mapped_ids``), with the number of their list of
    ids, ``n_ids`` and ``first_id``; and the lists: ``list, place, asset_id``, each id
    once, where it stands first."""
    lists = cut(found.select("mapped_ids").distinct().withColumn("list", F.monotonically_increasing_id()))
    each = lists.select("list", F.posexplode(F.split("mapped_ids", ", ")).alias("p", "entry"))
    each = each.join(entries.select("entry", "asset_ids"), "entry").select("list", "p", F.posexplode("asset_ids").alias("q", "asset_id"))
    held = cut(each.groupBy("list", "asset_id").agg(F.min(F.struct("p", "q")).alias("place")))
    sizes = held.groupBy("list").agg(F.count("*").alias("n_ids"), F.min_by("asset_id", "place").alias("first_id"))
    known = found.drop("n_ids").join(lists.join(sizes, "list"), "mapped_ids").drop("mapped_ids")
    plain = F.col("method").isin("attribute", "attribute_auto_selected")
    known = known.withColumn("method", F.when(plain & (F.col("n_ids") > 1), "attribute_auto_selected").when(plain, "attribute").otherwise(F.col("method")))
    return cut(known), held


def signature_matches(d: Dialect, table: Table) -> str:
    return _rows(d, table, text_signature_matches(d, table), _FOUND)


#: Of what is given out, for a task in the mean: bytes of lists that it names, far below the 1 MB of a file's dictionary, as some tasks get several times as much; and bytes that it repeats.
TASK_LISTS, TASK_BYTES = 1 << 16, 1 << 31


def with_lists(rows: DataFrame, held: DataFrame, task_lists: int = TASK_LISTS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``rows`` (with ``list``) with the text of their list, ``mapped_ids``, made once of
    ``held``.  Rows meet it last of all, those of one list side by side and a list of
    many rows in several tasks; so no shuffle carries a text for each row, and files
    name it once where they have a dictionary."""
    text = F.array_join(F.array_sort(F.collect_list(F.struct("place", "asset_id")))["asset_id"], ", ")
    sizes = rows.groupBy("list").agg(F.count("*").alias("rows"))
    lists = held.groupBy("list").agg(text.alias("mapped_ids")).join(sizes, "list")
    lists = cut(lists.withColumns({"length": F.length("mapped_ids").cast("long"), "parts": F.ceil(F.col("rows") * F.length("mapped_ids") / task_bytes)}).withColumn("parts", F.greatest("parts", F.lit(1))))
    named, repeated = lists.agg(F.coalesce(F.sum(F.col("length") * F.col("parts")), F.lit(0)), F.coalesce(F.sum(F.col("length") * F.col("rows")), F.lit(0))).first()
    tasks = 1 + max(named // task_lists, repeated // task_bytes)
    keys = ["list", "turn"]
    dealt = rows.join(lists.select("list", "parts"), "list").withColumn("turn", F.pmod(F.xxhash64("row_id"), "parts")).drop("parts").repartition(tasks, *keys)
    each = lists.select("list", "mapped_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("turn")).repartition(tasks, *keys)
    return dealt.join(each, keys).drop(*keys)


class _Listed(Query):
    """Matches with their lists of ids.  Under Spark they are found by the names of
    entries (``known``), for lists and the rows that have them both grow with the
    tables; DuckDB runs the plain query."""

    def __init__(self, build: Callable[[Dialect, Table], str], known: Callable[[Dialect, Table], str]):
        super().__init__(build)
        self.known = known

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        shared = lambda name: Query(lambda d, table: f"SELECT * FROM {table(name)}").spark(spark, sf_dir)
        known, held = known_ids(cut(Query(self.known).spark(spark, sf_dir)), shared("known_entries"))
        rows = shared("input_list").select("row_id", "query", "own_brand").join(known, ["query", "own_brand"])
        found = with_lists(cut(rows.select("row_id", "list", "n_ids", "matched_on", "method", "match_score")), held)
        return found.select("row_id", *_FOUND.split(", "))


def paired(d: Dialect, table: Table, left: list[str], right: list[str]) -> str:
    """Each input row with one of the catalog rows of its brand and category; over
    all rows, every catalog row of a bucket is met."""
    asked = f"SELECT row_id, brand AS own, category AS kind, {', '.join(left)} FROM {d.fence(input_features(d, table))} AS f WHERE whole5 >= 0"
    place = "row_number() OVER (PARTITION BY brand, category ORDER BY nl_pos) - 1"
    known = f"SELECT nl_pos, brand AS c_own, category AS c_kind, {', '.join(right)}, {place} AS place FROM {d.fence(catalog.features(d, table))} AS f WHERE whole2 >= 0"
    sizes = f"SELECT brand AS s_own, category AS s_kind, count(*) AS n FROM {d.fence(catalog.features(d, table))} AS f WHERE whole2 >= 0 GROUP BY brand, category"
    sized = f"SELECT l.*, row_id % n AS turn FROM ({asked}) AS l JOIN ({sizes}) AS s ON l.own = s.s_own AND l.kind = s.s_kind"
    return f"SELECT * FROM ({sized}) AS q JOIN ({known}) AS c ON q.own = c.c_own AND q.kind = c.c_kind AND q.turn = c.place"


def pairs(d: Dialect, table: Table) -> str:
    return f"SELECT row_id, nl_pos, q_norm, c_norm FROM ({paired(d, table, ['query AS q_norm'], ['normalized_name AS c_norm'])}) AS p"


def text_attributes(d: Dialect) -> dict[str, Callable[[str], str]]:
    """What the gates ask of either text of a pair, by name."""
    groups = {"aluminium": "aluminium|aluminum|alum", "steel": "steel|stainless", "titanium": "titan", "ceramic": "ceramic", "plastic": "plastic|polycarbonate"}
    found = (("cat", a.category), ("storage", a.storage), ("mm", a.watch_mm), ("tokens", a.model_tokens), ("edition", a.watch_edition), ("code", a.model_code), ("gen", a.tablet_generation), ("inches", a.screen_inches), ("year", a.year), ("identity", a.model_identity))
    return {name: lambda v, fn=fn: fn(d, v) for name, fn in found} | {
        "variants": lambda v: d.join(a.variant_tokens(d, v), ","),
        "material": lambda v: d.case(*((d.has(v, p), f"'{g}'") for g, p in groups.items())),
        "line": lambda v: d.join(d.keep(d.words(("air", "lite", "pro", "se")), lambda e: f"contains(concat(' ', {v}, ' '), concat(' ', {e}, ' '))"), ","),
    }


def told_layer(d: Dialect) -> Layer:
    telling = lambda v: d.distinct(d.keep(v, lambda e: f"NOT {d.has(e, '^20[012][0-9]$')} AND NOT {d.has(e, '^[a-z]{1,3}[0-9]{3,6}[a-z]{0,3}$')}"))
    return {"q_told": telling("q_tokens"), "c_told": telling("c_tokens")}


def pair_layers(d: Dialect) -> list[Layer]:
    return [{f"{s}_{name}": fn(f"{s}_norm") for name, fn in text_attributes(d).items() for s in "qc"}, told_layer(d)]


def _differ(d: Dialect, name: str, label: str) -> str:
    return f"CASE WHEN q_{name} <> '' AND c_{name} <> '' AND q_{name} <> c_{name} THEN concat('{label}:', q_{name}, '->', c_{name}) END"


def gate_reasons(d: Dialect) -> str:
    """Why a pair must not count as matched; an empty list lets it pass."""
    q, c = (d.join(f"{s}_told", " ") for s in "qc")
    n = {s: d.size(f"{s}_told") for s in "qc"}
    both = lambda k: f"q_cat = '{k}' AND c_cat = '{k}'"
    items = [
        "CASE WHEN q_cat <> 'other' AND c_cat <> 'other' AND q_cat <> c_cat THEN concat('category_cross:', q_cat, '->', c_cat) END",
        _differ(d, "storage", "storage_mismatch"),
        _differ(d, "mm", "watch_mm_mismatch"),
        f"CASE WHEN {n['q']} > 0 AND {n['c']} > 0 AND {n['q']} <> {n['c']} THEN concat('model_token_count:', {q}, '->', {c}) WHEN {n['q']} > 0 AND {n['c']} > 0 AND {q} <> {c} THEN concat('model_token_mismatch:', {q}, '->', {c}) WHEN {n['q']} > 0 AND {d.size('c_tokens')} = 0 THEN concat('model_token_missing_in_candidate:', {q}) END",
        _differ(d, "material", "material_mismatch"),
        f"CASE WHEN {both('watch')} AND q_material <> '' AND c_material = '' THEN concat('watch_material_missing_in_candidate:', q_material) END",
        "CASE WHEN q_cat <> 'watch' AND c_cat <> 'watch' OR q_edition = c_edition THEN NULL WHEN q_edition <> '' AND c_edition <> '' THEN concat('watch_edition_mismatch:', q_edition, '->', c_edition) WHEN q_edition <> '' THEN concat('watch_edition_missing_in_candidate:', q_edition) ELSE concat('watch_edition_missing_in_query:', c_edition) END",
        "CASE WHEN q_variants <> c_variants THEN concat('variant_mismatch:', q_variants, '->', c_variants) END",
        _differ(d, "code", "model_code_mismatch"),
        f"CASE WHEN {both('tablet')} AND q_line <> '' AND c_line <> '' AND q_line <> c_line THEN concat('tablet_line_mismatch:', q_line, '->', c_line) WHEN {both('tablet')} AND q_line <> '' AND c_line = '' THEN concat('tablet_line_missing_in_candidate:', q_line) END",
        f"CASE WHEN {both('tablet')} AND q_gen <> '' AND c_gen <> '' AND q_gen <> c_gen THEN concat('tablet_generation_mismatch:', q_gen, '->', c_gen) END",
        f"CASE WHEN {both('tablet')} AND abs({d.number('q_inches')} - {d.number('c_inches')}) > 0.15 THEN concat('screen_inches_mismatch:', q_inches, '->', c_inches) END",
        "CASE WHEN q_year <> '' AND c_year <> '' AND q_year <> c_year AND (q_cat IN ('tablet', 'laptop') OR c_cat IN ('tablet', 'laptop')) THEN concat('year_mismatch:', q_year, '->', c_year) END",
        identity_reason(),
    ]
    return d.keep(d.array(*items), lambda e: f"{e} IS NOT NULL")


def identity_reason() -> str:
    return "CASE WHEN q_identity <> '' AND c_identity <> '' AND q_identity <> c_identity THEN concat('model_identity_mismatch:', q_identity, '!=', c_identity) WHEN q_identity <> '' AND c_identity = '' THEN concat('model_identity_missing_in_candidate:', q_identity) END"


def _gate(d: Dialect, table: Table) -> str:
    inner = layered_sql(pairs(d, table), [*pair_layers(d), {"reasons": gate_reasons(d)}])
    return f"SELECT row_id, nl_pos, {d.size('reasons')} = 0 AS passes, {d.join('reasons', '; ')} AS reasons FROM ({inner}) AS g"


def _identity_guard(d: Dialect, table: Table) -> str:
    return f"SELECT row_id, nl_pos, q_identity, c_identity, coalesce({identity_reason()}, '') AS reason FROM ({layered_sql(pairs(d, table), pair_layers(d))}) AS g"


def critical_ok(d: Dialect) -> str:
    """Whether category, case size, storage and model words let a pair be the same product."""
    common, primary = d.size(d.both("q_tokens", "c_tokens")), d.at("q_tokens", 0)
    has_primary = d.size(d.keep("c_tokens", lambda e: f"{e} = {primary}"))
    return d.case(
        ("q_cat <> c_cat AND q_cat <> 'other' AND c_cat <> 'other'", "false"),
        ("q_mm <> '' AND c_mm <> '' AND q_mm <> c_mm", "false"),
        ("q_storage <> '' AND c_storage <> '' AND q_storage <> c_storage", "false"),
        (f"{d.size('q_tokens')} > 0 AND {d.size('c_tokens')} > 0", f"{common} > 0 AND {has_primary} > 0"),
        (f"{d.size('q_tokens')} > 0", "false"),
        other="true",
    )


def _critical(d: Dialect, table: Table) -> str:
    return f"SELECT row_id, nl_pos, {critical_ok(d)} AS verified FROM ({layered_sql(pairs(d, table), pair_layers(d))}) AS g"


def token_guard(d: Dialect) -> str:
    """The most that a score may be, by model words and case sizes; the cut-off is 85."""
    n = {s: d.size(f"{s}_tokens") for s in "qc"}
    return d.case(
        ("q_mm <> '' AND c_mm <> '' AND q_mm <> c_mm", "84"),
        (f"{n['q']} > 0 AND {n['c']} > 0 AND {d.join('q_tokens', ' ')} <> {d.join('c_tokens', ' ')}", "84"),
        (f"{n['q']} > 0 AND {n['c']} = 0", "84"),
        (f"{n['q']} = 0 AND {n['c']} > 0", "89"),
        other="100",
    )


def _guarded(d: Dialect, table: Table) -> str:
    return f"SELECT row_id, nl_pos, CAST({token_guard(d)} AS BIGINT) AS most FROM ({layered_sql(pairs(d, table), pair_layers(d))}) AS g"


def _recovered(d: Dialect, table: Table) -> str:
    """The name of a row whose own is missing or a link: from another column of
    names, else from a link; then without colours, with the storage column's text."""
    raw = f"SELECT {', '.join(f'{v} AS {k}' for k, v in INPUT.items())} FROM {table('orders')}"
    bad = lambda v: f"(lower(trim(coalesce({v}, ''))) IN ('', 'nan', 'none') OR {x.is_url(d, v)})"
    layers = [
        INPUT_LAYER,
        {"said": "CASE WHEN row_id % 5 = 0 THEN in_url WHEN row_id % 7 = 0 THEN 'nan' ELSE in_name END", "second": "CASE WHEN row_id % 10 = 0 THEN base_name END", "link": "CASE WHEN row_id % 3 = 0 THEN in_url END", "capacity": "CASE WHEN row_id % 4 = 0 THEN '128GB' END"},
        {"is_bad": bad("said"), "second_bad": bad("second"), "said_path": x.url_path(d, "said"), "link_path": x.url_path(d, "link")},
        {"said_name": x.url_name(d, "said_path"), "link_name": x.url_name(d, "link_path")},
        {"found": d.case(("NOT is_bad", "said"), ("NOT second_bad", "trim(second)"), ("link_name <> ''", "link_name"), (f"{x.is_url(d, 'said')}", "said_name"))},
        {"why": d.case(("found <> ''", "''"), (x.is_url(d, "said"), "'URL_NOT_PARSED'"), other="'EMPTY_PRODUCT_NAME'"), "plain": x.strip_colours(d, "found")},
    ]
    return f"SELECT row_id, found, why, trim(concat(plain, ' ', coalesce(capacity, ''))) AS asked FROM ({layered_sql(raw, layers)}) AS r"


def _breakdown(d: Dialect, table: Table) -> str:
    """Five agreements and a composite score."""
    digits = lambda s: f"coalesce({d.at(d.keep(f'{s}_tokens', lambda e: d.has(e, '[0-9]')), 0)}, '')"
    odd = d.keep(d.chain(d.only("q_tokens", "c_tokens"), d.only("c_tokens", "q_tokens")), lambda e: f"NOT {d.has(e, '^20[12][0-9]$')}")
    words = lambda s: d.slice(d.split(f"{s}_norm"), 2)
    flags = {
        "category_match": "(q_cat = c_cat OR q_cat = 'other' OR c_cat = 'other')",
        "storage_match": "NOT (q_storage <> '' AND c_storage <> '' AND q_storage <> c_storage)",
        "watch_mm_match": "NOT (q_mm <> '' AND c_mm <> '' AND q_mm <> c_mm)",
        "model_match": f"CASE WHEN {d.size('q_tokens')} = 0 OR {d.size('c_tokens')} = 0 THEN true WHEN {d.size(d.both('q_tokens', 'c_tokens'))} = 0 THEN false WHEN {digits('q')} <> '' AND {digits('c')} <> '' AND {digits('q')} <> {digits('c')} THEN false ELSE {d.size(odd)} = 0 END",
        "brand_match": f"(q_norm = '' OR c_norm = '' OR {d.size(d.both(words('q'), words('c')))} > 0)",
    }
    inner = layered_sql(pairs(d, table), [*pair_layers(d), flags])
    score = "greatest(0, 100 - CASE WHEN category_match THEN 0 ELSE 50 END - CASE WHEN model_match THEN 0 ELSE 30 END - CASE WHEN storage_match THEN 0 ELSE 15 END - CASE WHEN watch_mm_match THEN 0 ELSE 20 END - CASE WHEN brand_match THEN 0 ELSE 10 END)"
    return f"SELECT row_id, nl_pos, {', '.join(flags)}, CAST({score} AS DOUBLE) AS composite FROM ({inner}) AS b"


def _differs(field: str, label: str, one_sided: bool = False, value: Callable[[str], str] = str) -> str:
    q, c = value(f"q_{field}"), value(f"c_{field}")
    missing = f" WHEN {q} <> '' AND {c} = '' THEN concat('{label}_missing:', {q})" if one_sided else ""
    return f"CASE WHEN {q} <> '' AND {c} <> '' AND {q} <> {c} THEN concat('{label}:', {q}, '!=', {c}){missing} END"


def _worded(label: str, q: str, c: str, when: str = "true") -> str:
    return f"CASE WHEN {when} AND {q} <> {c} THEN concat('{label}:', {q}, '!=', {c}) END"


def variant_layers(d: Dialect) -> list[Layer]:
    """What the variant checks need beside the attributes ``q_*`` and ``c_*``."""
    said = lambda s: f"concat({s}_product_line, ' ', {s}_model)"
    crit = lambda s: d.join(d.sort(d.keep(f"{s}_variant_tokens", lambda e: d.isin(e, t.TABLET_VARIANTS))), ",")
    out: Layer = {}
    for s in "qc":
        out |= {f"{s}_words": d.join(a.variant_tokens(d, said(s)), ","), f"{s}_critical": crit(s), f"{s}_number": families.galaxy_number(d, f"{s}_model"), f"{s}_galaxy": families.galaxy_variant(d, f"{s}_model", said(s)), f"{s}_plain_model": x.normalize_text(d, f"{s}_model"), f"{s}_size": d.either(f"{s}_screen_inches", f"{s}_screen_size")}
    return [out]


def variant_reasons(d: Dialect, kind: str) -> str:
    """Differences of a pair's attributes: of ``any`` product, or by the stricter rules of one kind."""
    galaxy, zenfone = d.contains("q_product_line", "galaxy"), d.contains("q_product_line", "zenfone")
    both_sizes = f"q_size <> '' AND c_size <> '' AND CASE WHEN {d.number('q_size')} IS NULL OR {d.number('c_size')} IS NULL THEN q_size <> c_size ELSE abs({d.number('q_size')} - {d.number('c_size')}) > 0.15 END"
    generic = " AND ".join(f"NOT {d.isin(f'{s}_model', t.GENERIC_MODELS)}" for s in "qc")
    items = {
        "any": [
            _differs("material", "material"),
            f"CASE WHEN {generic} THEN {_differs('model', 'model')} END",
            _worded("variant_tokens", "q_words", "c_words"),
            _differs("watch_mm", "watch_mm"),
            _differs("connectivity", "connectivity"),
        ],
        "mobile": [
            _differs("brand", "mobile_brand"),
            _differs("product_line", "mobile_product_line"),
            _differs("plain_model", "mobile_model"),
            _differs("storage", "mobile_storage"),
            _differs("model_number", "mobile_model_number", value=lambda v: f"lower({v})"),
            _worded("mobile_variant", "q_words", "c_words"),
            f"CASE WHEN {galaxy} THEN {_differs('number', 'samsung_s_number')} END",
            _worded("samsung_variant", "q_galaxy", "c_galaxy", galaxy),
            f"CASE WHEN {zenfone} AND q_model_number <> '' AND c_model_number = '' THEN 'zenfone_model_number_missing:candidate_has_none' END",
        ],
        "tablet": [
            _differs("tablet_family", "tablet_family"),
            f"CASE WHEN {both_sizes} THEN concat('tablet_size:', q_size, '!=', c_size) END",
            _differs("generation", "tablet_generation"),
            _differs("year", "tablet_year"),
            _worded("tablet_variant", "q_critical", "c_critical"),
            f"CASE WHEN q_critical = c_critical THEN {_differs('tablet_line', 'tablet_line', True)} END",
            _differs("model_number", "tablet_model_number", value=lambda v: f"lower({v})"),
            _differs("chip", "tablet_chip"),
            _differs("storage", "tablet_storage"),
        ],
        "laptop": [_differs("brand", "laptop_brand"), *(_differs(f, f"laptop_{n}", True) for f, n in (("product_line", "series"), ("processor", "processor"), ("generation", "generation"), ("ram", "ram"), ("storage", "storage"), ("platform_code", "platform_code"), ("laptop_family", "family"), ("model_code", "model_code")))],
    }[kind]
    return d.keep(d.array(*items), lambda e: f"{e} IS NOT NULL")


def _variants(kind: str):
    def build(d: Dialect, table: Table) -> str:
        met = paired(d, table, [f"{n} AS q_{n}" for n in a.FIELDS], [f"{n} AS c_{n}" for n in a.FIELDS])
        where = "" if kind == "any" else f" WHERE q_category = '{kind}' AND c_category = '{kind}'"
        inner = layered_sql(f"SELECT * FROM ({met}) AS p{where}", variant_layers(d))
        return f"SELECT row_id, nl_pos, {d.join(variant_reasons(d, kind), '; ')} AS mismatches FROM ({inner}) AS v"

    return build


def _bucket_join(d: Dialect, table: Table) -> str:
    """Candidates of each row: catalog names of its brand and category."""
    right = f"SELECT brand, category, count(DISTINCT normalized_name) AS n FROM {d.fence(catalog.features(d, table))} AS f WHERE whole2 >= 0 GROUP BY brand, category"
    return f"SELECT q.row_id, q.brand, q.category, CAST(coalesce(b.n, 0) AS BIGINT) AS n_candidates FROM {d.fence(input_features(d, table))} AS q LEFT JOIN ({right}) AS b ON q.brand = b.brand AND q.category = b.category WHERE q.whole5 >= 0"


def _presence(kind: str):
    def build(d: Dialect, table: Table) -> str:
        known = f"SELECT DISTINCT {x.normalize_brand(d, 'nl_brand')} AS brand FROM {d.fence(catalog.clean(d, table))} AS c"
        return f"SELECT row_id, own_brand FROM {d.fence(inputs(d, table))} AS i WHERE whole4 >= 0 AND own_brand {'IN' if kind == 'semi' else 'NOT IN'} (SELECT brand FROM ({known}) AS k)"

    return build


_ID = "concat('A', CAST(row_id % 2500 AS STRING))"


def _names(d: Dialect, table: Table) -> str:
    left = f"SELECT row_id, {_ID} AS mapped FROM (SELECT o_orderkey AS row_id FROM {table('orders')}) AS o"
    return f"SELECT l.row_id, l.mapped, coalesce(c.nl_name, 'N/A') AS product_name FROM ({left}) AS l LEFT JOIN {d.fence(catalog.clean(d, table))} AS c ON c.uae_assetid = l.mapped"


def _crosswalk(d: Dialect, table: Table) -> str:
    """Ids of another catalog; one that stands for several there is ambiguous."""
    mapping = f"SELECT DISTINCT concat('A', CAST(p_partkey % 900 AS STRING)) AS uae, concat('M', CAST(p_partkey % 1300 AS STRING)) AS mms FROM {table('part')}"
    grouped = f"SELECT uae, count(DISTINCT mms) AS n, min(mms) AS mms FROM ({mapping}) AS m GROUP BY uae"
    left = f"SELECT row_id, {_ID} AS mapped FROM (SELECT o_orderkey AS row_id FROM {table('orders')}) AS o"
    return f"SELECT l.row_id, l.mapped, CASE WHEN m.n = 1 THEN m.mms ELSE '' END AS mms_id, CASE WHEN m.n IS NULL THEN 'NOT_FOUND' WHEN m.n > 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS mms_status FROM ({left}) AS l LEFT JOIN ({grouped}) AS m ON m.uae = l.mapped"


def _missing_ids(d: Dialect, table: Table) -> str:
    left = f"SELECT row_id, {_ID} AS mapped FROM (SELECT o_orderkey AS row_id FROM {table('orders')}) AS o"
    return f"SELECT l.row_id, l.mapped FROM ({left}) AS l LEFT JOIN {d.fence(catalog.clean(d, table))} AS c ON c.uae_assetid = l.mapped WHERE c.uae_assetid IS NULL"


QUERIES: dict[str, Query] = {
    "d19_query_text": Query(lambda d, t_: f"SELECT row_id, own_brand, query FROM {d.fence(inputs(d, t_))} AS i WHERE whole4 >= 0"),
    "j1_attribute": _Listed(attribute_matches, known_by_attributes),
    "j2_signature": _Listed(signature_matches, known_by_signature),
    "j3_bucket": Query(_bucket_join),
    "j12_names": Query(_names),
    "j13_crosswalk": Query(_crosswalk),
    "j16_brand_semi": Query(_presence("semi")),
    "j16_brand_anti": Query(_presence("anti")),
    "j17_id_anti": Query(_missing_ids),
    "d1_gate": Query(_gate),
    "d11_token_guard": Query(_guarded),
    "d19a_recovered": Query(_recovered),
    "d2_identity": Query(_identity_guard),
    "d3_variant": Query(_variants("any")),
    "d4_mobile": Query(_variants("mobile")),
    "d5_tablet": Query(_variants("tablet")),
    "d6_laptop_gate": Query(_variants("laptop")),
    "d8_critical": Query(_critical),
    "d9_breakdown": Query(_breakdown),
}
