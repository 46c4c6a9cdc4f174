"""Lists of ids that many texts share are taken apart once."""

from catalith.functions.dialect import SPARK
from catalith.operators import audits, cascade, matching, selection
from tests.test_variants import CHOICES


def test_choice_by_names_equals_choice_by_ids(spark):
    wanted, held, ids, names, place = [], [], [], [], 0
    for n, (said, listed, _, _) in enumerate(CHOICES):
        own = []
        for name in listed * 3:  # each name has three ids
            place += 1
            own.append(f"A{place}")
            names.append((f"A{place}", place, name))
            held.append((n, place, f"A{place}"))
        for query in ("q", "r"):  # two texts share a list
            wanted.append((query + str(n), "b", said, n))
            ids.append((query + str(n), "b", said, own))
    wanted.append(("lost", "b", "x", 99))
    ids.append(("lost", "b", "x", ["Z1", "Z2"]))
    held += [(99, 1, "Z1"), (99, 2, "Z2")]
    named = spark.createDataFrame(names, "uae_assetid string, nl_pos long, nl_name string")
    got = selection.choose_named(spark.createDataFrame(wanted, "query string, own_brand string, plain string, list long"), spark.createDataFrame(held, "list long, place int, asset_id string"), named)
    named.createOrReplaceTempView("named_ids")
    spark.createDataFrame(ids, "query string, own_brand string, plain string, ids array<string>").createOrReplaceTempView("wanted_ids")
    want = spark.sql(selection.choose(SPARK, "SELECT * FROM wanted_ids", "SELECT * FROM named_ids")).collect()
    assert {r.query: (r.selected_id, r.selection_reason, r.other_ids, r.n_ids) for r in got.collect()} == {r.query: (r.selected_id, r.selection_reason, r.other_ids[:3], len(r.other_ids) + 1) for r in want}
    assert len(want) == 2 * len(CHOICES) + 1


def test_entries_stand_for_their_ids(spark):
    entries = spark.createDataFrame([("a1", ["A1", "A2"]), ("a2", ["A2", "A3"]), ("s1", ["A9"])], "entry string, asset_ids array<string>")
    found = spark.createDataFrame([("p", "a1, a2", "attribute_tier2_multi_variant"), ("q", "a1", "attribute"), ("r", "s1", "attribute_auto_selected"), ("s", "a1", "attribute")], "query string, mapped_ids string, method string").selectExpr("*", "0 AS n_ids")
    known, held = matching.known_ids(found, entries)
    lists = {}
    for r in held.orderBy("list", "place").collect():
        lists.setdefault(r.list, []).append(r.asset_id)
    got = {r.query: (lists[r.list], r.n_ids, r.first_id, r.method) for r in known.collect()}
    assert got == {"p": (["A1", "A2", "A3"], 3, "A1", "attribute_tier2_multi_variant"), "q": (["A1", "A2"], 2, "A1", "attribute_auto_selected"), "r": (["A9"], 1, "A9", "attribute"), "s": (["A1", "A2"], 2, "A1", "attribute_auto_selected")}
    assert len(lists) == 3  # 'q' and 's' share one


def test_comparisons_carry_no_lists_of_ids(spark):
    rows = spark.createDataFrame([("apple", "mobile", f"iphone 1{i % 2}", i, f"A{i}") for i in range(6)], "brand string, category string, normalized_name string, nl_pos long, uae_assetid string")
    names = cascade._names(rows)
    asked = spark.createDataFrame([("iphone 10", "apple", "mobile", "apple", "mobile")], "query string, brand string, category string, in_brand string, in_category string")
    plain = cascade._compared(asked.selectExpr("*", "0.0D AS least", "CAST(NULL AS STRING) AS need"), names, 0.0, 2)
    assert not {"asset_id", "ids"} & set(plain.columns)
    one, every = (cascade.top_names(asked, names, 2, lists=x).collect()[0].near for x in (False, True))
    assert [(n.rank, n.id, n.name, n.asset_id) for n in one] == [(1, "A0", "iphone 10", None), (2, "A1", "iphone 11", None)]
    assert [n.asset_id for n in every] == ["A0, A2, A4", "A1, A3, A5"]


def test_best_candidates_need_no_shuffle(spark):
    def listed(*scores):
        return "[" + ", ".join(f'{{"uae_assetid": "{i}", "uae_assetname": "n", "score": {s}, "reason": "r"}}' for i, s in scores) + "]"

    rows = [(1, "REVIEW_REQUIRED", listed(("b", 80.0), ("a", 80.0), ("z", "null")), listed(("c", 95.5))), (2, "REVIEW_REQUIRED", "[]", listed(("z", "null"), ("y", 0.0))), (3, "MATCHED", listed(("a", 1.0)), "[]")]
    spark.createDataFrame(rows, "row_id long, match_status string, alternatives string, blocked_candidates string").createOrReplaceTempView("reviewed")
    best = spark.sql(audits.best_candidates(SPARK, "SELECT * FROM reviewed"))
    assert sorted(tuple(r) for r in best.collect()) == [(1, "a", 80.0, 2), (1, "b", 80.0, 3), (1, "c", 95.5, 1), (2, "y", 0.0, 1), (2, "z", None, 2)]
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString()
