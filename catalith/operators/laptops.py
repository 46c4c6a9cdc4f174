"""Laptops by their parts: an additive score over the names of a brand, with hard conditions.

Text and catalog name must not contradict each other in line, family, codes,
processor, generation, memory, storage or chip (processor and memory do not rule
out a MacBook).  What agrees adds to the score.  A text that leaves out parts its
class of laptops needs, that has two storages, or whose best name leads by too
little, goes to review.
"""

from __future__ import annotations

from catalith.functions import attributes as a
from catalith.functions import text as x
from catalith.functions.dialect import Dialect
from catalith.operators import catalog, matching
from catalith.plans.layers import layered_sql
from catalith.plans.query import Query, Table, shared

#: Least scores with and without an equal code, least score for review, least lead.
WITH_CODE, WITHOUT_CODE, WEAK, MARGIN = 85, 100, 60, 10
_KEYS = "query, own_brand, plain"
_PARTS = {"proc": "processor", "gen": "generation", "ram": "ram", "storage": "storage", "line": "product_line", "pc": "platform_code", "fam": "laptop_family", "mc": "model_code", "screen": "screen_inches", "chip": "apple_chip", "year": "year"}
_OWN = {"proc": "l_processor", "gen": "l_generation2", "ram": "l_ram", "storage": "l_storage", "line": "l_line", "pc": "l_platform", "fam": "l_family", "mc": "l_code", "screen": "l_inches", "chip": "l_chip", "year": "l_year"}


@shared("laptop_texts")
def laptop_texts(d: Dialect, table: Table) -> str:
    """Distinct texts of laptops with their parts, read from the text without words of retail."""
    said = f"SELECT DISTINCT i.query, i.own_brand, i.plain FROM {d.fence(matching.inputs(d, table))} AS i WHERE whole4 >= 0"
    known = f"SELECT query AS t_query, own_brand AS t_brand, brand FROM {d.fence(matching.texts(d, table))} AS t WHERE whole6 >= 0 AND category = 'laptop' AND asks_laptop AND own_brand <> ''"
    met = f"SELECT s.*, k.brand FROM ({said}) AS s JOIN ({known}) AS k ON s.query = k.t_query AND s.own_brand = k.t_brand"
    layers = [{"retail": x.laptop_text(d, "plain")}, {"laptop_query": x.normalize_text(d, "retail")}, *a.laptop_layers(d, "laptop_query", "own_brand"), {"policy": a.policy_class(d, "plain", "own_brand", "l_line")}]
    inner = layered_sql(met, layers)
    return f"SELECT {_KEYS}, brand, laptop_query, policy, l_storages, {', '.join(f'{v} AS q_{k}' for k, v in _OWN.items())}, {d.whole} AS whole7 FROM ({inner}) AS l"


def _names(d: Dialect, table: Table) -> str:
    """Names of laptops in the catalog with their parts and ids."""
    parts = ", ".join(f"min({v}) AS c_{k}" for k, v in _PARTS.items())
    return f"SELECT brand AS c_brand, normalized_name AS nl_name, min(nl_pos) AS pos, {d.ordered('uae_assetid', 'nl_pos')} AS ids, {parts} FROM {d.fence(catalog.features(d, table))} AS f WHERE category = 'laptop' AND whole2 >= 0 GROUP BY brand, normalized_name"


def _same(part: str) -> str:
    return f"(q_{part} <> '' AND c_{part} <> '' AND q_{part} = c_{part})"


def _apart(part: str) -> str:
    return f"(q_{part} <> '' AND c_{part} <> '' AND q_{part} <> c_{part})"


_RELATED = "(q_line <> '' AND c_line <> '' AND (q_line = c_line OR contains(q_line, c_line) OR contains(c_line, q_line)))"
_MAC = "policy = 'APPLE_MACBOOK'"


def scored(d: Dialect, table: Table) -> str:
    """All names that do not contradict a text, with score and what agrees."""
    entry = f"CASE WHEN {_MAC} THEN q_line <> '' AND (q_storage <> '' OR q_chip <> '' OR q_year <> '') ELSE q_proc <> '' AND q_ram <> '' AND q_storage <> '' END"
    met = f"SELECT q.*, c.* FROM {d.fence(laptop_texts(d, table))} AS q JOIN ({_names(d, table)}) AS c ON q.brand = c.c_brand WHERE q.whole7 >= 0 AND {entry}"
    lined = f"SELECT *, max(CASE WHEN {_RELATED} THEN 1 ELSE 0 END) OVER (PARTITION BY {_KEYS}) AS any_line FROM ({met}) AS m"
    apart = [f"(q_line <> '' AND c_line <> '' AND NOT {_RELATED})", *(_apart(p) for p in ("fam", "mc", "pc", "gen", "storage", "chip")), f"(NOT {_MAC} AND ({_apart('proc')} OR {_apart('ram')}))"]
    worth = [("code_match", 100, f"({_same('pc')} OR {_same('mc')})"), ("cpu", 40, _same("proc")), ("gen", 40, _same("gen")), ("ram", 30, _same("ram")), ("storage", 30, _same("storage")), ("screen", 10, _same("screen")), ("line", 15, _RELATED), ("chip", 40, _same("chip")), ("year", 10, _same("year"))]
    score = " + ".join(f"CASE WHEN {test} THEN {n} ELSE 0 END" for _, n, test in worth)
    detail = d.join(d.keep(d.array(*(f"CASE WHEN {test} THEN '{name}' END" for name, _, test in worth)), lambda e: f"{e} IS NOT NULL"), "+")
    kept = f"SELECT *, {score} AS score, {detail} AS detail FROM ({lined}) AS l WHERE (any_line = 0 OR {_RELATED}) AND NOT ({' OR '.join(apart)})"
    order = f"(PARTITION BY {_KEYS} ORDER BY score DESC, pos)"
    return f"SELECT *, row_number() OVER {order} AS place, lead(score) OVER {order} AS next FROM ({kept}) AS k WHERE score > 0"


def _missing(d: Dialect) -> str:
    """What a text of its class must say and does not."""
    need = {
        _MAC: [("q_line = ''", "product_line"), ("q_storage = ''", "storage"), ("q_chip = '' AND q_year = '' AND q_screen = ''", "chip_or_year_or_screen")],
        "policy = 'WINDOWS_GAMING'": [("q_proc = ''", "processor"), ("q_ram = ''", "ram"), ("q_storage = ''", "storage"), ("q_mc = '' AND q_fam = '' AND q_pc = ''", "code_or_family")],
    }
    rest = [("q_proc = ''", "processor"), ("q_gen = ''", "generation"), ("q_ram = ''", "ram"), ("q_storage = ''", "storage"), ("q_pc = '' AND q_fam = ''", "code_or_family")]
    listed = lambda rules: d.join(d.keep(d.array(*(f"CASE WHEN {test} THEN '{name}' END" for test, name in rules)), lambda e: f"{e} IS NOT NULL"), ",")
    return d.case(*((when, listed(rules)) for when, rules in need.items()), other=listed(rest))


def matches(d: Dialect, table: Table) -> str:
    """``query, own_brand, plain``, ids, score, status, confidence, matched name, method and reason."""
    top = lambda n: f"max(CASE WHEN place = 1 THEN {n} END) AS {n}"
    flat = d.distinct(d.flat("ids", "place"))
    first = ", ".join(top(n) for n in ("score", "nl_name", "detail", "policy", "missing", "two_storages"))
    marked = f"SELECT *, {_missing(d)} AS missing, CASE WHEN {d.size('l_storages')} >= 2 THEN {d.join(d.each('l_storages', lambda e: f'CAST({e} AS STRING)'), ', ')} ELSE '' END AS two_storages FROM ({scored(d, table)}) AS s WHERE place <= 3"
    grouped = f"SELECT {_KEYS}, {first}, coalesce(max(CASE WHEN place = 1 THEN next END), 0) AS next, {flat} AS top_ids, {d.first_by('ids', 'place')} AS own_ids FROM ({marked}) AS m GROUP BY {_KEYS}"
    least = f"CASE WHEN contains(detail, 'code_match') THEN {WITH_CODE} ELSE {WITHOUT_CODE} END"
    lead = "score - next"
    incomplete, narrow = "CASE WHEN missing <> '' THEN concat('incomplete(', missing, ')') END", f"CASE WHEN {lead} < {MARGIN} THEN concat('margin(', score, '-', next, '=', {lead}, '<{MARGIN})') END"
    why = d.join(d.keep(d.array(incomplete, narrow), lambda e: f"{e} IS NOT NULL"), "; ")
    kind = d.case(("two_storages <> ''", "'dual'"), (f"score < {least} AND score >= {WEAK}", "'weak'"), (f"score < {least}", "'none'"), (f"missing <> '' OR {lead} < {MARGIN}", "'unsure'"), (f"{d.size('own_ids')} = 1", "'one'"), other="'several'")
    reason = d.case(
        ("kind = 'dual'", "concat('dual_storage([', two_storages, ']); top candidates shown')"),
        ("kind = 'weak'", f"concat('below threshold (', score, '<', {least}, '); attrs=', detail)"),
        ("kind = 'unsure'", f"concat({why}, '; attrs=', detail)"),
        ("kind = 'one'", "concat('policy=', policy, '; attrs=', detail)"),
        other=f"concat('multiple NL IDs, no tie-breaker; candidates: ', {d.join('own_ids', '; ')})",
    )
    ids = d.case(("kind = 'several'", d.join("own_ids", ", ")), other=f"coalesce({d.at('top_ids', 0)}, '')")
    status, sure = d.case(("kind = 'one'", "'MATCHED'"), other="'REVIEW_REQUIRED'"), d.case(("kind = 'one'", "'HIGH'"), ("kind = 'weak'", "'LOW'"), other="'MEDIUM'")
    others = d.case(("kind = 'one'", d.no_strings), ("kind = 'several'", "own_ids"), other=d.keep("top_ids", lambda e: f"{e} <> {d.at('top_ids', 0)}"))
    told = f"SELECT *, {kind} AS kind FROM ({grouped}) AS g"
    return f"SELECT {_KEYS}, {ids} AS mapped_ids, CAST(score AS DOUBLE) AS match_score, {status} AS match_status, {sure} AS confidence, nl_name AS matched_on, 'laptop_attribute_match' AS method, {reason} AS selection_reason, {others} AS other_ids FROM ({told}) AS k WHERE kind <> 'none'"


def _query(d: Dialect, table: Table) -> str:
    return f"SELECT query, own_brand, plain, mapped_ids, match_score, match_status, confidence, matched_on, method, selection_reason, CAST({d.size('other_ids')} AS BIGINT) AS n_others FROM ({matches(d, table)}) AS m"


QUERIES: dict[str, Query] = {"j9_laptops": Query(_query)}
