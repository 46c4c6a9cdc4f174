"""Reports and audits on the results of a run, for any table of results.

``source`` is the SQL of a table with the columns of ``cascade.pipeline_v2``.  The
queries ``r_*`` report on the pipeline's own results; the others on composed rows,
which DuckDB can read too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalith.functions import families
from catalith.functions import text as x
from catalith.functions.dialect import SPARK, Dialect
from catalith.operators import catalog, cascade
from catalith.operators.reports import results
from catalith.plans.layers import layered_sql
from catalith.plans.materialize import cut
from catalith.plans.query import Query, Table

Report = Callable[[Dialect, str], str]
_RISK = "match_status = 'MATCHED' AND NOT verification_pass"
_REVIEW, _NO = "match_status = 'REVIEW_REQUIRED'", "match_status = 'NO_MATCH'"


def coverage(d: Dialect, source: str) -> str:
    """Counts and shares of statuses, near misses, matches that fail a gate, and the mean score of matches."""
    n = {k: d.count_if(f"match_status = '{s}'") for k, s in (("matched", "MATCHED"), ("review", "REVIEW_REQUIRED"), ("no_match", "NO_MATCH"), ("multiple", "MULTIPLE_MATCHES"))}
    rate = lambda k: f"CAST(round(100.0 * {n[k]} / count(*), 1) AS DOUBLE) AS {k}_rate"
    return f"SELECT CAST(count(*) AS BIGINT) AS total, {', '.join(f'{v} AS {k}_count' for k, v in n.items())}, {', '.join(rate(k) for k in ('matched', 'review', 'no_match'))}, {d.count_if(f'{_NO} AND match_score >= 80')} AS near_miss, {d.count_if(_RISK)} AS at_risk, coalesce(round(avg(CASE WHEN match_status = 'MATCHED' THEN match_score END), 2), 0.0) AS mean_score FROM ({source}) AS r"


def gaps(d: Dialect, source: str) -> str:
    """Brands and names without a match, near misses, and coverage of brands and categories."""
    own, said = "lower(trim(brand))", "lower(trim(original_input))"
    count, matched = "CAST(count(*) AS BIGINT)", d.count_if("match_status = 'MATCHED'")
    rate = f"CAST(round(100.0 * {matched} / count(*), 1) AS DOUBLE)"
    part = lambda name, key, n, share, rest: f"SELECT '{name}' AS part, {key} AS item, {n} AS n, {share} AS value FROM ({source}) AS r {rest}"
    none = "CAST(NULL AS DOUBLE)"
    near = f"SELECT 'near_miss' AS part, matched_on AS item, row_id AS n, match_score AS value FROM (SELECT * FROM ({source}) AS r WHERE {_NO} AND match_score >= 80 AND match_score < 85 ORDER BY row_id LIMIT 50) AS k"
    known = "NOT IN ('', 'nan', 'none')"
    return " UNION ALL ".join([
        part("unmatched_brand", own, count, none, f"WHERE {_NO} GROUP BY {own}"),
        part("often_unmatched", said, count, none, f"WHERE {_NO} GROUP BY {said} HAVING count(*) >= 3"),
        near,
        part("brand_coverage", own, count, rate, f"WHERE {own} {known} GROUP BY {own}"),
        part("category_coverage", "category", count, rate, f"WHERE lower(category) {known} GROUP BY category"),
    ])


def _grouped(d: Dialect, source: str, where: str, words: int = 3) -> str:
    """Rows with brand, category and the key of their family."""
    own = d.either(x.normalize_brand(d, "brand"), "lower(coalesce(brand, ''))")
    layers = [*families.family_layers(d, "original_input", "category", "brand"), families.group_layer(d, "brand", words), {"own": own}]
    return layered_sql(f"SELECT row_id, brand, category, original_input FROM ({source}) AS g0 WHERE {where}", layers)


def add_requests(d: Dialect, source: str, top: int = 3) -> str:
    """What the catalog likely lacks, by brand, category and family, with the first
    few names of each group; names are ranked, not gathered (G8)."""
    each = _grouped(d, source, "no_match_reason = 'CATALOG_MISSING_LIKELY'")
    keys = "own, family_category, group_key"
    names = f"SELECT {keys}, original_input, min(row_id) AS first_row, count(*) AS n, max(family_key) AS family_key FROM ({each}) AS e GROUP BY {keys}, original_input"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY first_row) AS place FROM ({names}) AS k"
    pick = ", ".join(f"coalesce(max(CASE WHEN place = {i} THEN original_input END), '') AS example_{i}" for i in range(1, top + 1))
    return f"SELECT own AS brand, family_category AS category, max(family_key) AS model_family_key, group_key, CAST(sum(n) AS BIGINT) AS n, {pick} FROM ({ranked}) AS p GROUP BY {keys}"


def _counted(section: str, key: str, source: str, where: str, top: int = 0) -> str:
    inner = f"SELECT {key} AS k, count(*) AS n FROM ({source}) AS c WHERE {where} GROUP BY {key}"
    limit = f" ORDER BY n DESC, k LIMIT {top}" if top else ""
    return f"SELECT '{section}' AS section, k AS item, CAST(n AS STRING) AS value FROM (SELECT * FROM ({inner}) AS i{limit}) AS t"


def diagnostics(d: Dialect, source: str) -> str:
    """The diagnostics sheet (G9): statuses by category, reasons, gate reasons, what the catalog lacks, laptops."""
    reasons = f"SELECT reason, category FROM ({source}) AS q {d.explode(d.split_on('verification_reasons', '; '), 'reason')} WHERE verification_reasons <> ''"
    statuses = " UNION ALL ".join(f"SELECT '{s}' AS status" for s in ("MATCHED", "REVIEW_REQUIRED", "NO_MATCH"))
    totals = f"SELECT category, count(*) AS total FROM ({source}) AS t1 WHERE category IS NOT NULL GROUP BY category"
    counts = f"SELECT category, match_status, count(*) AS n FROM ({source}) AS t2 GROUP BY category, match_status"
    grid = f"SELECT 'category_status' AS section, concat(g.category, ' / ', s.status) AS item, concat(CAST(coalesce(c.n, 0) AS STRING), ' (', {d.percent('100.0 * coalesce(c.n, 0) / g.total')}, ')') AS value FROM ({totals}) AS g CROSS JOIN ({statuses}) AS s LEFT JOIN ({counts}) AS c ON c.category = g.category AND c.match_status = s.status"
    missing = _grouped(d, source, "no_match_reason = 'CATALOG_MISSING_LIKELY'")
    laptops = _grouped(d, source, "category = 'laptop' AND no_match_reason IN ('CATALOG_MISSING_LIKELY', 'RETRIEVAL_WEAK')", 4)
    return " UNION ALL ".join([
        grid,
        _counted("no_match_reason", "no_match_reason", source, "true"),
        _counted("review_reason", "review_reason", source, "review_reason <> ''"),
        _counted("gate_block", "reason", reasons, "reason <> ''", 20),
        _counted("catalog_missing_other", "group_key", missing, "lower(coalesce(category, 'other')) IN ('other', '', 'nan', 'none')", 20),
        _counted("catalog_missing_brand", "CASE WHEN own = '' THEN 'unknown' ELSE own END", missing, "true", 20),
        _counted("laptop_missing_gk", "group_key", laptops, "true", 20),
        _counted("laptop_review_summary", "substr(review_summary, 1, 80)", source, f"category = 'laptop' AND {_REVIEW} AND review_summary <> ''", 10),
        _counted("laptop_gate_reason", "reason", reasons, f"category = 'laptop' AND {d.starts('reason', chr(39) + 'laptop_' + chr(39))}", 10),
        _counted("laptop_no_match_reason", "no_match_reason", source, "category = 'laptop'"),
    ])


def schema_audit(d: Dialect, source: str) -> str:
    """Whether alternatives are readable, have all their parts and numeric scores, and whether reviews have candidates."""
    read = f"SELECT *, {d.candidates('alternatives')} AS alts, {d.candidates('blocked_candidates')} AS blk, {d.parses('alternatives')} AS readable FROM ({source}) AS s"
    each = f"SELECT a FROM ({read}) AS r {d.explode('alts', 'a')}"
    whole = "a.uae_assetid IS NOT NULL AND a.uae_assetname IS NOT NULL AND a.score IS NOT NULL AND a.reason IS NOT NULL"
    row = lambda name, of, ok, where="true", least=1.0, bad="FAIL": f"SELECT '{name}' AS audit, CAST(count(*) AS BIGINT) AS total, {d.count_if(ok)} AS ok, CAST(count(*) - {d.count_if(ok)} AS BIGINT) AS fail, CASE WHEN count(*) = 0 OR {d.count_if(ok)} >= {least} * count(*) THEN 'PASS' ELSE '{bad}' END AS status FROM ({of}) AS o WHERE {where}"
    return " UNION ALL ".join([
        row("alternatives_json_parseable", read, "readable"),
        row("alternatives_schema_correct", each, whole),
        row("alternatives_score_numeric", each, "a.score IS NOT NULL"),
        row("review_alt_or_blk_coverage", read, f"{d.size('alts')} > 0 OR {d.size('blk')} > 0", _REVIEW, 0.95, "WARN"),
    ])


def review_flat(d: Dialect, source: str) -> str:
    """Review rows with their candidates in columns, the best score, the id to
    suggest and the queue: quick from 90, deep below (X11, X12, X19, O2, D24)."""
    read = f"SELECT *, {d.candidates('alternatives')} AS alts, {d.candidates('blocked_candidates')} AS blk FROM ({source}) AS s WHERE {_REVIEW}"
    part = lambda kind, i, f: f"{d.at(kind, i)}.{f}"
    cells = ", ".join(f"coalesce({part(kind, i, f)}, {0.0 if f == 'score' else chr(39) * 2}) AS {name}_{i + 1}_{short}" for name, kind in (("alt", "alts"), ("blk", "blk")) for i in range(3) for f, short in (("uae_assetid", "id"), ("uae_assetname", "name"), ("score", "score"), ("reason", "reason")))
    flat = f"SELECT row_id, match_score, review_priority, {cells} FROM ({read}) AS r"
    best = "greatest(alt_1_score, blk_1_score)"
    return f"SELECT *, {best} AS best_score, CASE WHEN blk_1_score > alt_1_score THEN blk_1_id ELSE alt_1_id END AS suggested_id, CASE WHEN {best} >= 90 THEN 'quick' ELSE 'deep' END AS queue FROM ({flat}) AS f"


def best_candidates(d: Dialect, source: str, top: int = 3) -> str:
    """The best candidates of each review row, of alternatives and blocked ones."""
    read = f"SELECT row_id, {d.chain(d.candidates('alternatives'), d.candidates('blocked_candidates'))} AS cands FROM ({source}) AS s WHERE {_REVIEW}"
    if d is SPARK:  # ordered inside the row, for its candidates may name long lists of ids; no row_id stands twice
        order = "c.score IS NULL AS none, NOT coalesce(isnan(c.score), false) AS number, -c.score AS below, c.uae_assetid AS id, c.score AS score"
        best = f"SELECT row_id, slice(array_sort(transform(cands, c -> struct({order}))), 1, {top}) AS best FROM ({read}) AS r"
        return f"SELECT row_id, b.id AS id, b.score AS score, CAST(at + 1 AS BIGINT) AS place FROM ({best}) AS t LATERAL VIEW posexplode(best) lv AS at, b"
    each = f"SELECT row_id, c.uae_assetid AS id, c.score AS score FROM ({read}) AS r {d.explode('cands', 'c')}"
    return f"SELECT row_id, id, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY score DESC, id) AS BIGINT) AS place FROM ({each}) AS e) AS p WHERE place <= {top}"


def accuracy(d: Dialect, source: str, names: str) -> str:
    """Whether what was selected among several agrees with the reason that was given."""
    met = f"SELECT r.row_id, r.selection_reason AS why, lower(r.original_input) AS said, lower(c.nl_name) AS chosen FROM ({source}) AS r LEFT JOIN ({names}) AS c ON r.mapped_uae_assetid = c.uae_assetid WHERE r.auto_selected"
    low = "lower(why)"
    error = d.case(
        ("chosen IS NULL", "'id not in catalog'"),
        (f"{d.contains(low, 'matched year')}", f"CASE WHEN contains(chosen, {d.ext(low, r'matched year ([0-9]{4})')}) THEN '' ELSE 'year not in product' END"),
        (f"{d.contains(low, 'matched 5g')}", f"CASE WHEN NOT {d.contains('said', '5g')} THEN 'no 5G in input' WHEN NOT {d.contains('chosen', '5g')} THEN 'no 5G in product' ELSE '' END"),
        (f"({d.contains(low, 'matched 4g/lte')} OR {d.contains(low, 'defaulted to 4g')})", f"CASE WHEN {d.contains('chosen', '5g')} THEN '5G in product' ELSE '' END"),
    )
    return f"SELECT error, CAST(count(*) AS BIGINT) AS n FROM (SELECT {error} AS error FROM ({met}) AS m) AS e GROUP BY error"


def summary(d: Dialect, source: str) -> str:
    """A row for each sheet and one for all, with shares as text."""
    n = {k: d.count_if(f"match_status = '{s}'") for k, s in (("matched", "MATCHED"), ("multiple", "MULTIPLE_MATCHES"), ("review", "REVIEW_REQUIRED"), ("no_match", "NO_MATCH"))}
    return f"SELECT coalesce(source_sheet, 'TOTAL') AS sheet, CAST(count(*) AS BIGINT) AS n, {', '.join(f'{v} AS {k}' for k, v in n.items())}, {d.percent('100.0 * ' + n['matched'] + ' / count(*)')} AS match_rate FROM ({source}) AS r GROUP BY ROLLUP (source_sheet)"


def problem_order(d: Dialect, source: str) -> str:
    """Rows with problems first: by status, then score; the place comes from counts of
    (status, score) pairs and a row's place among equals, so no sheet is one task (O3)."""
    rank = "CASE match_status WHEN 'MULTIPLE_MATCHES' THEN 0 WHEN 'REVIEW_REQUIRED' THEN 1 WHEN 'NO_MATCH' THEN 2 ELSE 3 END"
    ranked = f"SELECT row_id, source_sheet, match_status, match_score, {rank} AS problem FROM ({source}) AS r"
    counts = f"SELECT source_sheet, problem, match_score, count(*) AS n FROM ({ranked}) AS k GROUP BY source_sheet, problem, match_score"
    before = f"SELECT *, sum(n) OVER (PARTITION BY source_sheet ORDER BY problem, match_score) - n AS ahead FROM ({counts}) AS c"
    own = f"SELECT *, row_number() OVER (PARTITION BY source_sheet, problem, match_score ORDER BY row_id) AS turn FROM ({ranked}) AS w"
    return f"SELECT o.row_id, o.match_status, CAST(b.ahead + o.turn AS BIGINT) AS place FROM ({own}) AS o JOIN ({before}) AS b ON o.source_sheet = b.source_sheet AND o.problem = b.problem AND o.match_score = b.match_score"


def analyst_review(d: Dialect, source: str) -> str:
    """What an analyst sees of review rows."""
    return f"SELECT source_sheet, row_id, brand, original_input, mapped_uae_assetid, matched_on, match_score, confidence_note, review_reason, review_summary, review_priority FROM (SELECT *, CASE WHEN verification_pass THEN 'gate passed' ELSE verification_reasons END AS confidence_note FROM ({source}) AS s) AS r WHERE {_REVIEW}"


def unmatched(d: Dialect, source: str, names: str) -> str:
    """Rows without a match, with the name of the nearest product where there is one."""
    return f"SELECT r.row_id, r.brand, r.original_input, r.no_match_reason, r.match_score, coalesce(c.nl_name, 'N/A') AS product_name FROM ({source}) AS r LEFT JOIN ({names}) AS c ON r.mapped_uae_assetid = c.uae_assetid WHERE r.{_NO}"


def overridden(d: Dialect, source: str, overrides: str) -> str:
    """Results with ids that a person has set (D23); ``overrides`` has row_id and new_id."""
    return f"SELECT r.row_id, coalesce(o.new_id, r.mapped_uae_assetid) AS mapped_uae_assetid, CASE WHEN o.new_id IS NOT NULL THEN 'MATCHED' ELSE r.match_status END AS match_status, CASE WHEN o.new_id IS NOT NULL THEN 'Manually overridden' ELSE r.selection_reason END AS selection_reason FROM ({source}) AS r LEFT JOIN ({overrides}) AS o ON r.row_id = o.row_id"


def mapped_alternatives(d: Dialect, source: str, mapping: str) -> str:
    """The counterparts in another catalog of a row's id and of its first three
    alternatives and blocked candidates (J13); ``mapping`` has uae, n and mms."""
    read = f"SELECT row_id, mapped_uae_assetid AS own, {d.candidates('alternatives')} AS alts, {d.candidates('blocked_candidates')} AS blk FROM ({source}) AS s"
    lists = {"alt": "alts", "blk": "blk"}
    ids = [("main", "own"), *((f"{n}_{i + 1}", f"{d.at(k, i)}.uae_assetid") for n, k in lists.items() for i in range(3))]
    each = " UNION ALL ".join(f"SELECT row_id, '{name}' AS place, {value} AS id FROM ({read}) AS r" for name, value in ids)
    status = "CASE WHEN m.n IS NULL THEN 'NOT_FOUND' WHEN m.n > 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END"
    return f"SELECT e.row_id, e.place, e.id, CASE WHEN m.n = 1 THEN m.mms ELSE '' END AS mms_id, {status} AS mms_status FROM ({each}) AS e LEFT JOIN ({mapping}) AS m ON e.id = m.uae WHERE e.id IS NOT NULL AND e.id <> ''"


_REPORTS: dict[str, Report] = {"coverage": coverage, "gaps": gaps, "add_requests": add_requests, "diagnostics": diagnostics, "schema_audit": schema_audit, "review_flat": review_flat, "best_candidates": best_candidates, "summary": summary, "problem_order": problem_order, "analyst_review": analyst_review}
_IDS = {"coverage": "g6_coverage", "gaps": "g7_all_gaps", "add_requests": "g8_requests", "diagnostics": "g9_sheet", "schema_audit": "g11_schema_audit", "review_flat": "x12_review_flat", "best_candidates": "o7_best_candidates", "summary": "g12_summary", "problem_order": "o3_problem_order", "analyst_review": "f6_analyst_review"}


def _names(d: Dialect, table: Table) -> str:
    return f"SELECT uae_assetid, nl_name FROM {d.fence(catalog.clean(d, table))} AS n"


def _mapping(table: Table) -> str:
    pairs = f"SELECT DISTINCT concat('A', CAST(p_partkey % 900 AS STRING)) AS uae, concat('M', CAST(p_partkey % 1300 AS STRING)) AS mms FROM {table('part')}"
    return f"SELECT uae, count(DISTINCT mms) AS n, min(mms) AS mms FROM ({pairs}) AS m GROUP BY uae"


QUERIES: dict[str, Query] = {_IDS[name]: Query(lambda d, t, f=f: f(d, results(d, t))) for name, f in _REPORTS.items()} | {
    "g24_accuracy": Query(lambda d, t: accuracy(d, results(d, t), _names(d, t))),
    "f7_unmatched": Query(lambda d, t: unmatched(d, results(d, t), _names(d, t))),
    "d23_overridden": Query(lambda d, t: overridden(d, results(d, t), f"SELECT o_orderkey AS row_id, concat('X', CAST(o_orderkey AS STRING)) AS new_id FROM {t('orders')} WHERE o_orderkey % 9 = 0")),
    "j13_alternatives": Query(lambda d, t: mapped_alternatives(d, results(d, t), _mapping(t))),
}

_KEPT: dict[tuple[str, str], DataFrame] = {}


def pipeline_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's results, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        _KEPT[key] = cut(cascade.pipeline_v2(spark, sf_dir), "results")
    return _KEPT[key]


def _on_pipeline(report: Report) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: cascade._sql(spark, lambda results: report(SPARK, results), results=pipeline_results(spark, sf_dir))


def selection_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = cascade._shared(spark, sf_dir, "catalog_clean").select("uae_assetid", "nl_name")
    return cascade._sql(spark, lambda results, names: accuracy(SPARK, results, names), results=pipeline_results(spark, sf_dir), names=names)


def safety_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched rows through the strict checks of their category once more."""
    return cascade.audited(spark, sf_dir, pipeline_results(spark, sf_dir))


PIPELINE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"r_{name}": _on_pipeline(f) for name, f in _REPORTS.items()} | {"r_accuracy": selection_accuracy, "r_safety_audit": safety_audit}
