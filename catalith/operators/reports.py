"""Reports on mapped results: metrics, gaps, histograms, queues."""

from __future__ import annotations

from catalith.functions.dialect import Dialect
from catalith.plans.query import Query, Table, shared

_K = "o_orderkey"
_NO_MATCH = "match_status = 'NO_MATCH'"


@shared("mapped_results")
def results(d: Dialect, table: Table) -> str:
    """A list of mapped rows, composed from keys."""
    status = f"CASE {_K} % 10 WHEN 0 THEN 'MULTIPLE_MATCHES' WHEN 1 THEN 'REVIEW_REQUIRED' WHEN 2 THEN 'REVIEW_REQUIRED' WHEN 3 THEN 'NO_MATCH' WHEN 4 THEN 'NO_MATCH' ELSE 'MATCHED' END"
    score = f"CASE WHEN {_K} % 10 IN (3, 4) THEN CAST({_K} % 45 + 40 AS DOUBLE) WHEN {_K} % 10 IN (1, 2) THEN CAST(85 + {_K} % 5 AS DOUBLE) ELSE CAST(90 + {_K} % 11 AS DOUBLE) END"
    method = f"CASE {_K} % 4 WHEN 0 THEN 'attribute' WHEN 1 THEN 'signature' WHEN 2 THEN 'fuzzy' ELSE 'none' END"
    category = f"CASE {_K} % 7 WHEN 0 THEN 'laptop' WHEN 1 THEN 'tablet' WHEN 2 THEN 'watch' WHEN 3 THEN 'other' ELSE 'mobile' END"
    brand = f"CASE {_K} % 9 WHEN 0 THEN 'apple' WHEN 1 THEN 'samsung' WHEN 2 THEN 'dell' WHEN 3 THEN '' WHEN 4 THEN 'xiaomi' ELSE 'huawei' END"
    reasons = f"CASE {_K} % 6 WHEN 0 THEN 'storage_mismatch; variant_mismatch' WHEN 1 THEN 'category_cross' ELSE '' END"
    said = f"concat('product ', CAST({_K} % 211 AS STRING), CASE {_K} % 3 WHEN 0 THEN ' 5G' WHEN 1 THEN ' 2021' ELSE '' END)"
    why = f"CASE {_K} % 5 WHEN 0 THEN 'CATALOG_MISSING_LIKELY' WHEN 1 THEN 'BLOCKED_BY_GATE' WHEN 2 THEN 'RETRIEVAL_WEAK' WHEN 3 THEN 'CATALOG_MISSING_LIKELY' ELSE 'TAXONOMY_MISMATCH' END"
    review = f"CASE {_K} % 3 WHEN 0 THEN 'FUZZY_ONLY' WHEN 1 THEN 'GATE_BLOCKED_SUSPICIOUS' ELSE 'MULTI_ID_AMBIGUOUS' END"
    chosen = f"CASE {_K} % 7 WHEN 0 THEN 'Matched 5G (user has 5G)' WHEN 1 THEN 'Matched year 2021' WHEN 2 THEN 'Defaulted to 4G (user unspecified)' ELSE 'First ID (variants identical)' END"
    one = f"concat('{{\"uae_assetid\":\"A', CAST({_K} % 300 AS STRING), '\",\"uae_assetname\":\"name ', CAST({_K} % 17 AS STRING), '\",\"score\":', CAST(60 + {_K} % 39 AS STRING), '.5,\"reason\":\"fuzzy\"}}')"
    two = f"concat('{{\"uae_assetid\":\"B', CAST({_K} % 30 AS STRING), '\",\"uae_assetname\":\"other\",\"score\":', CAST(50 + {_K} % 49 AS STRING), '}}')"
    alternatives = f"CASE {_K} % 11 WHEN 0 THEN '' WHEN 1 THEN 'broken [' WHEN 2 THEN '[]' WHEN 3 THEN concat('[', {one}, ',', {two}, ']') ELSE concat('[', {one}, ']') END"
    blocked = f"CASE WHEN {_K} % 13 < 4 THEN concat('[', {two}, ']') ELSE '[]' END"
    more = f"{said} AS original_input, concat('A', CAST(1 + {_K} % 250 AS STRING)) AS mapped_uae_assetid, concat('catalog ', CAST({_K} % 190 AS STRING)) AS matched_on, {alternatives} AS alternatives, {blocked} AS blocked_candidates, CASE WHEN {_K} % 10 IN (3, 4) THEN {why} WHEN {_K} % 10 IN (1, 2) THEN '' ELSE 'SUCCESS' END AS no_match_reason, CASE WHEN {_K} % 10 IN (1, 2) THEN {review} ELSE '' END AS review_reason, {_K} % 6 <> 0 AS verification_pass, {reasons} AS verification_reasons, CASE WHEN {_K} % 10 IN (1, 2) THEN concat('summary ', CAST({_K} % 4 AS STRING)) ELSE '' END AS review_summary, CASE WHEN {_K} % 10 IN (1, 2) THEN CAST({_K} % 120 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS review_priority, {_K} % 10 >= 5 AND {_K} % 4 = 0 AS auto_selected, CASE WHEN {_K} % 10 >= 5 AND {_K} % 4 = 0 THEN {chosen} ELSE '' END AS selection_reason"
    return f"SELECT {more}, {_K} AS row_id, CASE {_K} % 3 WHEN 0 THEN 'List 1' ELSE 'List 2' END AS source_sheet, {status} AS match_status, {score} AS match_score, {method} AS method, {category} AS category, {brand} AS brand, concat('product ', CAST({_K} % 211 AS STRING)) AS name, concat('group ', CAST({_K} % 53 AS STRING)) AS group_key, {reasons} AS reasons FROM {table('orders')}"


def _over(select: str, tail: str = ""):
    return Query(lambda d, table: f"SELECT {select.format(d=d)} FROM ({results(d, table)}) AS r {tail}")


def _metrics(d: Dialect, table: Table) -> str:
    n = {s: d.count_if(f"match_status = '{s}'") for s in ("MATCHED", "MULTIPLE_MATCHES", "REVIEW_REQUIRED", "NO_MATCH")}
    counts = ", ".join(f"{x} AS {s.lower()}" for s, x in n.items())
    near, risk = d.count_if("match_status = 'NO_MATCH' AND match_score >= 80"), d.count_if("match_status = 'MATCHED' AND NOT verification_pass")
    mean = "coalesce(round(avg(CASE WHEN match_status = 'MATCHED' THEN match_score END), 2), 0.0)"
    return f"SELECT CAST(count(*) AS BIGINT) AS total, {counts}, CAST(round(100.0 * {n['MATCHED']} / count(*), 1) AS DOUBLE) AS matched_rate, {near} AS near_miss, {risk} AS at_risk, {mean} AS mean_score FROM ({results(d, table)}) AS r"


def _rollup(d: Dialect, table: Table) -> str:
    matched = d.count_if("match_status = 'MATCHED'")
    return f"SELECT coalesce(source_sheet, 'TOTAL') AS sheet, CAST(count(*) AS BIGINT) AS n, {matched} AS matched FROM ({results(d, table)}) AS r GROUP BY ROLLUP (source_sheet)"


def _gate_reasons(d: Dialect, table: Table) -> str:
    return f"SELECT reason, CAST(count(*) AS BIGINT) AS n FROM ({results(d, table)}) AS r {d.explode(d.split_on('reasons', '; '), 'reason')} WHERE reason <> '' GROUP BY reason"


def _diagnostics(d: Dialect, table: Table) -> str:
    """Counts and shares of all categories and statuses, zeros kept."""
    grid = "SELECT c.category, s.status FROM (SELECT 'mobile' AS category UNION ALL SELECT 'tablet' UNION ALL SELECT 'laptop' UNION ALL SELECT 'watch' UNION ALL SELECT 'other') AS c CROSS JOIN (SELECT 'MATCHED' AS status UNION ALL SELECT 'REVIEW_REQUIRED' UNION ALL SELECT 'NO_MATCH') AS s"
    counts = f"SELECT category, match_status, count(*) AS n, sum(count(*)) OVER (PARTITION BY category) AS total FROM ({results(d, table)}) AS r GROUP BY category, match_status"
    return f"SELECT g.category, g.status, CAST(coalesce(c.n, 0) AS BIGINT) AS n, CAST(round(100.0 * coalesce(c.n, 0) / coalesce(c.total, 1), 1) AS DOUBLE) AS pct FROM ({grid}) AS g LEFT JOIN ({counts}) AS c ON c.category = g.category AND c.match_status = g.status"


def _margin(d: Dialect, table: Table) -> str:
    """Each group's best row and its lead over the next."""
    ranked = f"SELECT group_key, row_id, match_score, row_number() OVER (PARTITION BY group_key ORDER BY match_score DESC, row_id) AS rn, lead(match_score) OVER (PARTITION BY group_key ORDER BY match_score DESC, row_id) AS next FROM ({results(d, table)}) AS r"
    return f"SELECT group_key, row_id, match_score, match_score - coalesce(next, 0) AS margin FROM ({ranked}) AS k WHERE rn = 1"


def _top(n: int, order: str, where: str = "true"):
    return lambda d, table: f"SELECT group_key, row_id, name, match_score, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY group_key ORDER BY {order}) AS BIGINT) AS rn FROM ({results(d, table)}) AS r WHERE {where}) AS k WHERE rn <= {n}"


def _requests(d: Dialect, table: Table) -> str:
    inner = f"SELECT brand, category, group_key, CAST(count(*) AS BIGINT) AS n, {d.slice(d.ordered('name', 'row_id'), 3)} AS examples FROM ({results(d, table)}) AS r WHERE match_status = 'NO_MATCH' GROUP BY brand, category, group_key"
    return f"SELECT brand, category, group_key, n, coalesce({d.at('examples', 0)}, '') AS example_1, coalesce({d.at('examples', 1)}, '') AS example_2, coalesce({d.at('examples', 2)}, '') AS example_3 FROM ({inner}) AS q"


def _difference(d: Dialect, table: Table) -> str:
    return f"SELECT DISTINCT name FROM ({results(d, table)}) AS r WHERE source_sheet = 'List 1' EXCEPT SELECT name FROM ({results(d, table)}) AS r WHERE source_sheet = 'List 2'"


def _membership(d: Dialect, table: Table) -> str:
    return f"SELECT name, max(CASE WHEN source_sheet = 'List 1' THEN true ELSE false END) AS in_1, max(CASE WHEN source_sheet = 'List 2' THEN true ELSE false END) AS in_2 FROM ({results(d, table)}) AS r GROUP BY name"


def _modes(d: Dialect, table: Table) -> str:
    return f"SELECT group_key, {d.mode('brand')} AS brand, {d.mode('category')} AS category, CAST(count(*) AS BIGINT) AS n FROM ({results(d, table)}) AS r WHERE match_status = 'NO_MATCH' GROUP BY group_key"


def _compare(d: Dialect, table: Table) -> str:
    other = "CASE WHEN row_id % 8 = 0 THEN 'NO_MATCH' ELSE match_status END"
    return f"SELECT a.row_id, a.match_status AS v2_status, b.v1_status FROM ({results(d, table)}) AS a JOIN (SELECT row_id, {other} AS v1_status FROM ({results(d, table)}) AS r) AS b ON a.row_id = b.row_id WHERE a.match_status <> b.v1_status"


def _union(d: Dialect, table: Table) -> str:
    part = "SELECT '{0}' AS sheet, row_id, name FROM ({1}) AS r WHERE source_sheet = '{0}'"
    return " UNION ALL ".join(part.format(s, results(d, table)) for s in ("List 1", "List 2"))


QUERIES: dict[str, Query] = {
    "f8_status_filters": _over("row_id, match_status", "WHERE match_status IN ('MATCHED', 'REVIEW_REQUIRED')"),
    "f9_near_miss": _over("row_id, match_score", "WHERE match_status = 'NO_MATCH' AND match_score >= 80 AND match_score < 85"),
    "g6_metrics": Query(_metrics),
    "g6_methods": _over("method, CAST(count(*) AS BIGINT) AS n", "GROUP BY method"),
    "g7_gaps": Query(lambda d, t: f"SELECT brand, category, CAST(count(*) AS BIGINT) AS n, {d.count_if(_NO_MATCH)} AS unmatched FROM ({results(d, t)}) AS r GROUP BY brand, category HAVING count(*) >= 3"),
    "g8_add_requests": Query(_requests),
    "g9_diagnostics": Query(_diagnostics),
    "g9_gate_reasons": Query(_gate_reasons),
    "g12_rollup": Query(_rollup),
    "g13_breakdown": _over("source_sheet, brand, category, match_status, CAST(count(*) AS BIGINT) AS n, round(avg(match_score), 2) AS mean_score", "GROUP BY source_sheet, brand, category, match_status"),
    "g15_missing_mode": Query(_modes),
    "g16_histogram": _over("CASE WHEN match_score >= 80 THEN '80-84' WHEN match_score >= 70 THEN '70-79' WHEN match_score >= 60 THEN '60-69' ELSE '<60' END AS bin, CAST(count(*) AS BIGINT) AS n", "WHERE match_status = 'NO_MATCH' GROUP BY 1"),
    "j18_compare": Query(_compare),
    "o1_review_queue": Query(_top(10, "match_score DESC, row_id", "match_status = 'REVIEW_REQUIRED'")),
    "o6_near_miss_top": Query(lambda d, t: f"SELECT row_id, name, match_score FROM ({results(d, t)}) AS r WHERE match_status = 'NO_MATCH' ORDER BY match_score DESC, row_id LIMIT 50"),
    "o2_quick_review": _over("row_id, match_score, CASE WHEN match_score >= 90 THEN 'quick' ELSE 'deep' END AS queue", "WHERE match_status = 'REVIEW_REQUIRED'"),
    "o3_problem_sort": _over("row_id, match_status, CAST(row_number() OVER (PARTITION BY source_sheet ORDER BY CASE match_status WHEN 'MULTIPLE_MATCHES' THEN 0 WHEN 'REVIEW_REQUIRED' THEN 1 WHEN 'NO_MATCH' THEN 2 ELSE 3 END, match_score, row_id) AS BIGINT) AS place"),
    "o5_lowest_brands": _over("brand, CAST(round(100.0 * sum(CASE WHEN match_status = 'MATCHED' THEN 1 ELSE 0 END) / count(*), 1) AS DOUBLE) AS rate", "GROUP BY brand ORDER BY rate, brand LIMIT 15"),
    "g17_risk": _over("source_sheet, CAST(sum(CASE WHEN match_status = 'MATCHED' AND (match_score < 95 OR reasons <> '') THEN 1 ELSE 0 END) AS BIGINT) AS false_positives, CAST(sum(CASE WHEN match_status = 'NO_MATCH' AND match_score >= 80 THEN 1 ELSE 0 END) AS BIGINT) AS missed", "GROUP BY source_sheet"),
    "x19_row_max": _over("row_id, greatest(match_score, CAST(row_id % 100 AS DOUBLE)) AS best"),
    "w1_best": Query(_top(1, "match_score DESC, row_id")),
    "w2_top3": Query(_top(3, "match_score DESC, row_id")),
    "w3_margin": Query(_margin),
    "x1_union": Query(_union),
    "x3_difference": Query(_difference),
    "x4_membership": Query(_membership),
}
