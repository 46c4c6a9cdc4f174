"""Golden cases of the scalar operators, in both engines, and of the cascade."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from catalith.functions import attributes as a
from catalith.functions import similarity
from catalith.functions import text as x
from catalith.functions.dialect import DUCK, SPARK
from catalith.operators import cascade

CASES = [
    (x.normalize_brand, "Apple Inc", "apple"),
    (x.normalize_brand, "Samsung Electronics Co", "samsung"),
    (x.normalize_brand, "HP OLD", "hp"),
    (x.normalize_brand, "Hewlett Packard", "hp"),
    (x.normalize_brand, "XIAOMI", "xiaomi"),
    (x.normalize_brand, None, ""),
    (x.infer_brand, "iPhone 15 128GB Bleu", "apple"),
    (x.infer_brand, "reno4 128GB", "oppo"),
    (x.infer_brand, "Unknown Device 128GB", ""),
    (x.strip_colours, "iPhone Xs 64gb Gris Sideral", "iPhone Xs 64gb"),
    (x.clean_url_name, "iphone 14 pro 256gb paars nano", "iphone 14 pro 256gb"),
    (x.clean_url_name, "iphone 15 256gb black eu a grade", "iphone 15 256gb"),
    (x.clean_url_name, "iphone 16 pro 256 gb titanium1", "iphone 16 pro 256 gb"),
    (x.normalize_text, "iPhone SE (2016) 64 GB", "iphone se 2016 64gb"),
    (x.normalize_text, "Galaxy S24+ 256 Go 5G", "galaxy s24 plus 256gb"),
    (x.normalize_text, "iPad 7th Generation 10.2", "ipad gen7 10 2"),
    (x.normalize_text, "Sony Mark III", "sony mk3"),
    (x.normalize_text, "Galaxy Z Fold 3", "galaxy z fold3"),
    (x.laptop_text, 'MacBook Pro (13" 2020, 4 TBT3)', "MacBook Pro 13 inch 2020"),
    (a.storage, "phone 4gb 64gb", "64gb"),
    (a.storage, "disk 1024gb", "1tb"),
    (a.storage, "", ""),
    (a.ram, "Latitude 8GB 256GB", "8gb"),
    (a.watch_mm, "watch 44 mm", "44mm"),
    (a.category, "apple ipad pro", "tablet"),
    (a.category, "galaxy watch 4", "watch"),
    (a.category, "asus rog phone 6", "mobile"),
    (a.category, "dell latitude 5420", "laptop"),
    (a.category, "table", "other"),
    (a.cpu_generation, "Core i5-8350U", "8th gen"),
    (a.cpu_generation, "Core i7-10750H", "10th gen"),
    (a.cpu_generation, "Ryzen 5 5500U", "ryzen 5"),
    (a.model_identity, "oppo reno4 pro 128gb", "reno4pro"),
    (a.model_identity, "redmi note 12 turbo", "note12turbo"),
    (a.model_identity, "xiaomi 14 ultra photography kit", "xiaomi14ultra"),
    (a.model_identity, "apple iphone 15 pro", ""),
    (a.screen_inches, "gen7 8", ""),
    (a.screen_inches, "ipad 12 9 inch", "12.9"),
    (a.watch_material, "watch ss 44mm", "stainless"),
]


@pytest.mark.parametrize(("fn", "text", "want"), CASES)
def test_golden_cases_in_duckdb(fn, text, want):
    assert duckdb.execute(f"SELECT {fn(DUCK, 'v')} FROM (SELECT CAST(? AS VARCHAR) AS v)", [text]).fetchone()[0] == want


def test_golden_cases_in_spark(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "i int, v string")
    for i, (fn, _, want) in enumerate(CASES):
        assert df.filter(f"i = {i}").selectExpr(f"{fn(SPARK, 'v')} AS got").first().got == want, CASES[i]


@settings(max_examples=100, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_common_letters_equal_dynamic_programming(p, q):
    row = [0] * (len(q) + 1)
    for c in p:
        new = [0]
        for j, e in enumerate(q, 1):
            new.append(row[j - 1] + 1 if c == e else max(row[j], new[-1]))
        row = new
    assert similarity.common_letters(p, q) == row[-1]


def test_names_of_queries_and_sql_agree():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90


def test_cascade_gives_each_row_once(spark):
    rows = cascade.pipeline_v2(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len({r.row_id for r in rows}) == 1500
    by_status = {s: sum(r.match_status == s for r in rows) for s in ("MATCHED", "MULTIPLE_MATCHES", "REVIEW_REQUIRED", "NO_MATCH")}
    assert sum(by_status.values()) == 1500 and by_status["MATCHED"] + by_status["MULTIPLE_MATCHES"] > 300
    assert all(r.verification_pass for r in rows if r.match_status == "MATCHED")
