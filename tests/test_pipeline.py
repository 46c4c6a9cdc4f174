"""Similarity and the whole cascade on the smallest table, against plain Python."""

import json
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from catalith.functions import attributes as a
from catalith.functions.dialect import DUCK
from catalith.functions.similarity import token_sort_ratio
from catalith.operators import audits, cascade

SF = "/root/testdata/sf0.001"


def plain_similar(spark, cutoff, top, fallback):
    """The most similar names of each text, by looking at all names of its scope."""
    catalog = cascade._shared(spark, SF, "catalog_features").select("brand", "category", "normalized_name", "nl_pos").collect()
    scopes = defaultdict(dict)
    for r in catalog:
        for b in (r.brand, "*"):
            for c in (r.category, "*"):
                scopes[b, c][r.normalized_name] = min(r.nl_pos, scopes[b, c].get(r.normalized_name, r.nl_pos))
    brands = {r.brand for r in catalog}
    asked = sorted({(r.query, r.brand, r.category) for r in cascade._shared(spark, SF, "input_features").select("query", "brand", "category").collect()})
    told = duckdb.execute(f"SELECT {a.storage(DUCK, 'v')}, {a.is_laptop(DUCK, 'v')} FROM (SELECT unnest(?) AS v)", [[q for q, _, _ in asked]]).fetchall()
    out = {}

    def best(query, names, least):
        scored = [(round(token_sort_ratio(query, n), 2), -p, n) for n, p in names.items()]
        return [(n, s) for s, _, n in sorted((x for x in scored if x[0] >= least), reverse=True)[:top]]

    for (query, brand, category), (size, laptop) in zip(asked, told, strict=True):
        other = category == "other"
        scope = ("*" if not brand or other and brand not in brands else brand, "*" if other else category)
        names = scopes.get(scope, {})
        held = {n: p for n, p in names.items() if size and size in n}
        found = best(query, held if held and len(names) > 20 else names, max(cutoff, 90 if not brand and other else 0))
        if fallback and names and scope[0] != "*" and not (category == "laptop" and laptop) and not any(s >= 85 for _, s in found):
            found = best(query, scopes["*", scope[1]], 85) or found
        for place, (n, s) in enumerate(found, 1):
            out[query, brand, category, place] = (n, s)
    return out


@pytest.mark.parametrize(("query", "cutoff", "top", "fallback"), [(cascade.fuzzy_best, 85, 1, True), (cascade.near_miss, 80, 3, False)])
def test_similar_names_equal_brute_force(spark, query, cutoff, top, fallback):
    got = {(r.query, r.brand, r.category, r["rank"]): (r.normalized_name, r.score) for r in query(spark, SF).collect()}
    assert got == plain_similar(spark, cutoff, top, fallback)


def test_the_cascade_and_its_reports(spark):
    results = audits.pipeline_results(spark, SF)
    rows = results.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/orders.parquet").count() == len({r.row_id for r in rows})
    ids = {r.uae_assetid for r in cascade._shared(spark, SF, "catalog_clean").collect()}
    for r in rows:
        alts, blocked = json.loads(r.alternatives), json.loads(r.blocked_candidates)
        assert r.match_status in ("MATCHED", "REVIEW_REQUIRED", "NO_MATCH")
        assert r.confidence == ("HIGH" if r.match_score >= 90 else r.confidence) or r.match_status != "MATCHED"
        assert (r.match_status == "REVIEW_REQUIRED") == (r.review_reason != "") and len(alts) <= 3 and len(blocked) <= 3
        assert r.review_summary or r.match_status == "MATCHED"
        assert all(set(c) == {"uae_assetid", "uae_assetname", "score", "reason"} for c in alts + blocked)
        if r.match_status == "MATCHED":
            assert r.mapped_uae_assetid in ids and r.verification_pass and r.no_match_reason == "SUCCESS" and "fuzzy" not in r.method
        if r.match_status == "REVIEW_REQUIRED":
            assert alts or blocked
            best = max([c["score"] for c in alts + blocked], default=0)
            extra = 15 if r.review_reason == "GATE_BLOCKED_SUSPICIOUS" else 10 if r.review_reason == "MULTI_ID_AMBIGUOUS" else 0
            assert r.review_priority == round(r.match_score + (20 if best >= 90 else 10 if best >= 80 else 0) + extra, 2)
        else:
            assert r.review_priority == 0
    queries = audits.PIPELINE_QUERIES
    sheet = {(r.section, r.item): r.value for r in queries["r_diagnostics"](spark, SF).collect()}
    reasons = Counter(r.no_match_reason for r in rows)
    assert {k: v for (s, k), v in sheet.items() if s == "no_match_reason"} == {k: str(v) for k, v in reasons.items()}
    counts, status = Counter(r.category for r in rows), Counter((r.category, r.match_status) for r in rows)
    for c, n in counts.items():
        for s in ("MATCHED", "REVIEW_REQUIRED", "NO_MATCH"):
            assert sheet["category_status", f"{c} / {s}"] == f"{status[c, s]} ({100 * status[c, s] / n:.1f}%)"
    coverage = queries["r_coverage"](spark, SF).first()
    assert coverage.total == len(rows) and coverage.matched_count == sum(r.match_status == "MATCHED" for r in rows) and coverage.at_risk == 0
    audit = {r.audit: r.status for r in queries["r_schema_audit"](spark, SF).collect()}
    assert set(audit.values()) == {"PASS"}
    assert all(r.n == 0 or r.status == "WARN" for r in queries["r_safety_audit"](spark, SF).collect())
    accuracy = {r.error: r.n for r in queries["r_accuracy"](spark, SF).collect()}
    assert sum(accuracy.values()) == results.filter("auto_selected").count()
    requests = queries["r_add_requests"](spark, SF).agg(F.sum("n")).first()[0] or 0
    assert requests == reasons["CATALOG_MISSING_LIKELY"]
