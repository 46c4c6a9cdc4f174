"""The first engine: its scoring of laptops, its wording of gates, and its texts."""

from __future__ import annotations

from catalith.functions import first_engine as f
from catalith.functions.dialect import Dialect
from catalith.operators import catalog, laptops, matching
from catalith.operators.scalars import _listing
from catalith.plans.layers import Plan, layered_sql
from catalith.plans.query import Query, Table

#: Least score of a match.
LEAST = 85
_PARTS = {"proc": "processor", "gen": "generation", "ram": "ram", "storage": "storage", "line": "product_line", "pc": "platform_code", "fam": "laptop_family", "mc": "model_code"}


def laptop_matches(d: Dialect, table: Table) -> str:
    """Of each laptop text with processor, memory and storage the first best name:
    these three must be equal, and so must the generation where either has one."""
    own = ", ".join(f"{v} AS q_{k}" for k, v in _PARTS.items())
    asked = f"SELECT query, own_brand, brand, {own} FROM {d.fence(matching.texts(d, table))} AS t WHERE whole6 >= 0 AND category = 'laptop' AND asks_laptop AND processor <> '' AND ram <> '' AND storage <> ''"
    parts = ", ".join(f"min({v}) AS c_{k}" for k, v in _PARTS.items())
    names = f"SELECT brand AS c_brand, normalized_name AS nl_name, min(nl_pos) AS pos, {d.ordered('uae_assetid', 'nl_pos')} AS ids, {parts} FROM {d.fence(catalog.features(d, table))} AS f WHERE category = 'laptop' AND whole2 >= 0 GROUP BY brand, normalized_name"
    same = "q_proc = c_proc AND q_ram = c_ram AND q_storage = c_storage AND q_gen = c_gen"
    apart = " OR ".join(laptops._apart(p) for p in ("pc", "fam", "mc"))
    lines = "q_line <> '' AND c_line <> ''"
    bonus = lambda p, n: f"CASE WHEN {laptops._same(p)} THEN {n} ELSE 0 END"
    score = f"80 + CASE WHEN q_gen <> '' THEN 15 ELSE 5 END + CASE WHEN {laptops._RELATED} THEN 15 WHEN q_line <> '' OR c_line <> '' THEN 5 ELSE 0 END + {bonus('pc', 5)} + {bonus('fam', 10)} + {bonus('mc', 10)}"
    met = f"SELECT q.query, q.own_brand, c.nl_name, c.pos, c.ids, {score} AS score FROM ({asked}) AS q JOIN ({names}) AS c ON q.brand = c.c_brand AND {same} WHERE NOT ({apart}) AND NOT ({lines} AND NOT {laptops._RELATED})"
    best = f"SELECT *, row_number() OVER (PARTITION BY query, own_brand ORDER BY score DESC, pos) AS place FROM ({met}) AS m"
    status = f"CASE WHEN {d.size('ids')} = 1 THEN 'MATCHED' ELSE 'REVIEW_REQUIRED' END"
    return f"SELECT query, own_brand, {d.join('ids', ', ')} AS mapped_ids, CAST(score AS DOUBLE) AS match_score, {status} AS match_status, nl_name AS matched_on FROM ({best}) AS b WHERE place = 1 AND score >= {LEAST}"


def _gate(d: Dialect, table: Table) -> str:
    """The gate in the first engine's words."""
    inner = layered_sql(matching.pairs(d, table), [*matching.pair_layers(d), {"reasons": matching.gate_reasons(d)}])
    return f"SELECT row_id, nl_pos, {d.size('reasons')} = 0 AS passes, replace({d.join('reasons', '; ')}, '->', '→') AS reasons FROM ({inner}) AS g"


QUERIES: dict[str, Query | Plan] = {
    "v1_is_url": _listing(lambda d: [{"is_url": f.is_url(d, "in_url")}], ["row_id", "is_url"], ("in_url",)),
    "v1_url_name": _listing(lambda d: [{"path": f.url_path(d, "in_url")}, {"url_name": f.url_name(d, "path")}], ["row_id", "in_url", "url_name"], ("in_url",)),
    "v1_colors": _listing(lambda d: [{"plain": f.strip_colours(d, "in_name")}], ["row_id", "plain"]),
    "v1_normalize": _listing(lambda d: [{"norm": f.normalize_text(d, "in_name")}], ["row_id", "norm"]),
    "v1_laptops": Query(laptop_matches),
    "v1_gate": Query(_gate),
}
