"""Family keys, strict checks, selection among several ids and laptop scoring: golden cases in DuckDB."""

import duckdb
import pytest

from catalith.functions import attributes as a
from catalith.functions import families
from catalith.functions.dialect import DUCK
from catalith.operators import matching, selection
from catalith.plans.layers import layered_sql

FAMILIES = [
    ("Samsung SM-N986B 256GB", "mobile", "samsung", "galaxy note (sm-n986)"),
    ("Samsung SM-G960F 64GB", "mobile", "samsung", "galaxy s (sm-g960)"),
    ("Xiaomi 15 Ultra 256GB", "mobile", "xiaomi", "xiaomi 15 ultra"),
    ("One Plus Nord 128GB", "mobile", "oneplus", "oneplus nord 128gb"),
    ("Samsung Galaxy S24+ 512GB", "mobile", "samsung", "galaxy s24 plus"),
    ("Samsung Galaxy S24 Plus 512GB", "mobile", "samsung", "galaxy s24 plus"),
    ("Apple iPhone 15 Pro Max 256GB", "mobile", "apple", "iphone 15 pro max"),
    ("Apple iPhone SE 2020 64GB", "mobile", "apple", "iphone se 2020"),
    ("Galaxy Z Fold 3 256GB", "mobile", "samsung", "galaxy zfold3"),
    ("Huawei P30 Lite", "mobile", "huawei", "huawei p30 lite"),
    ("Redmi Note 12 Pro", "mobile", "xiaomi", "redmi note 12"),
    ("Motorola Edge 40 Neo", "mobile", "motorola", "moto edge 40 neo"),
    ("Nokia Lumia 950", "mobile", "nokia", "lumia 950"),
    ("iPad Air 64GB", "tablet", "apple", "ipad air"),
    ("Galaxy Tab S9 FE", "tablet", "samsung", "galaxy tab s9 fe"),
    ("Surface Pro 7", "", "microsoft", "surface pro 7"),
    ("Apple Watch Series 8 45mm", "watch", "apple", "apple watch series 8 45mm"),
    ("Galaxy Watch 4 Classic 42mm", "watch", "samsung", "galaxy watch 4 classic 42mm"),
    ("Huawei Watch GT 3", "watch", "huawei", "huawei watch gt 3"),
    ("Dell Latitude 5420", "laptop", "dell", ""),
]


@pytest.mark.parametrize(("text", "category", "brand", "want"), FAMILIES)
def test_family_keys(text, category, brand, want):
    layers = families.family_layers(DUCK, "v", "c", "b")
    got = duckdb.execute(f"SELECT family_key FROM ({layered_sql('SELECT CAST(? AS VARCHAR) AS v, CAST(? AS VARCHAR) AS c, CAST(? AS VARCHAR) AS b', layers)}) AS f", [text, category, brand]).fetchone()[0]
    assert " ".join(got.split()) == want


def differences(kind, query, name, brand):
    """Reasons of the strict check of a kind for two texts."""
    def side(s, text):
        inner = layered_sql(f"SELECT '{text}' AS v, '{brand}' AS b", a.extract(DUCK, "v", "b"))
        return f"SELECT {', '.join(f'{f} AS {s}_{f}' for f in a.FIELDS)} FROM ({inner}) AS x{s}"

    pair = f"SELECT * FROM ({side('q', query)}) AS q, ({side('c', name)}) AS c"
    return duckdb.execute(f"SELECT {matching.variant_reasons(DUCK, kind)} FROM ({layered_sql(pair, matching.variant_layers(DUCK))}) AS v").fetchone()[0]


CHECKS = [
    ("mobile", "samsung galaxy s23 128gb", "samsung galaxy s23 128gb", "samsung", None),
    ("mobile", "samsung galaxy s23 ultra 128gb", "samsung galaxy s23 plus 128gb", "samsung", "samsung_variant:ultra!=plus"),
    ("mobile", "samsung galaxy s23 128gb", "samsung galaxy s24 128gb", "samsung", "samsung_s_number:s23!=s24"),
    ("mobile", "apple iphone 14 pro max 128gb", "apple iphone 14 pro 128gb", "apple", "mobile_variant:max,pro!=pro"),
    ("mobile", "apple iphone 14 128gb", "apple iphone 14 256gb", "apple", "mobile_storage:128gb!=256gb"),
    ("tablet", "apple ipad pro 11 inch 128gb", "apple ipad pro 12.9 inch 128gb", "apple", "tablet_size:11!=12.9"),
    ("tablet", "apple ipad mini 64gb", "apple ipad air 64gb", "apple", "tablet_family:ipad mini!=ipad air"),
    ("tablet", "apple ipad air 64gb", "apple ipad air 64gb", "apple", None),
    ("laptop", "dell latitude 5420 core i5 16gb 512gb", "dell latitude 5520 core i5 16gb 512gb", "dell", "laptop_platform_code:5420!=5520"),
    ("laptop", "dell latitude 5420 core i5 16gb 512gb", "dell latitude core i5 16gb 512gb", "dell", "laptop_platform_code_missing:5420"),
    ("any", "apple watch series 8 45mm titanium", "apple watch series 8 45mm aluminium", "apple", "material:titanium!=aluminum"),
    ("any", "apple watch series 8 45mm", "apple watch series 9 45mm", "apple", "model:series 8!=series 9"),
]


@pytest.mark.parametrize(("kind", "query", "name", "brand", "want"), CHECKS)
def test_strict_checks(kind, query, name, brand, want):
    got = differences(kind, query, name, brand)
    assert want in got if want else got == []


CHOICES = [
    ("Galaxy S23 5G 128GB", ["Galaxy S23 128GB", "Galaxy S23 5G 128GB"], 2, "Matched 5G (user has 5G)"),
    ("Galaxy S23 LTE 128GB", ["Galaxy S23 5G 128GB", "Galaxy S23 128GB"], 2, "Matched 4G/LTE (user has 4G/LTE)"),
    ("Galaxy S23 128GB", ["Galaxy S23 5G 128GB", "Galaxy S23 128GB"], 2, "Defaulted to 4G (user unspecified)"),
    ("Galaxy S23 128GB", ["Galaxy S23 128GB", "Galaxy S23 128GB EU"], 1, "First ID (variants identical)"),
    ("iPad Pro 2021", ["iPad Pro 2020", "iPad Pro 2021"], 2, "Matched year 2021, Pro"),
    ("Watch Series 8 Titanium", ["Watch Series 8 Aluminium", "Watch Series 8 Titanium"], 2, "Matched material:titanium"),
    ("Galaxy Z Fold 3", ["Galaxy Z Flip 3", "Galaxy Z Fold 2", "Galaxy Z Fold 3"], 3, "Matched fold3"),
    ("iPhone 13", ["iPhone 13 mini", "iPhone 13"], 2, "Matched model variant"),
    ("iPhone 14 Pro", ["iPhone 14 Pro Max", "iPhone 14 Pro"], 2, "Matched Pro"),
    ("iPhone 14 2020", ["iPhone 14 Ultra", "iPhone 14 Lite"], 1, "Matched year 2020"),
]


@pytest.mark.parametrize(("said", "names", "place", "reason"), CHOICES)
def test_selection_among_several(said, names, place, reason):
    ids = ", ".join(f"'A{i}'" for i in range(1, len(names) + 1))
    wanted = f"SELECT 'q' AS query, 'b' AS own_brand, '{said}' AS plain, [{ids}] AS ids"
    known = " UNION ALL ".join(f"SELECT 'A{i}' AS uae_assetid, {i} AS nl_pos, '{n}' AS nl_name" for i, n in enumerate(names, 1))
    got = duckdb.execute(selection.choose(DUCK, wanted, known)).fetchall()[0]
    if place != 1 or "identical" in reason:
        assert got[3:5] == (f"A{place}", reason)
    assert got[5] == [f"A{i}" for i in range(1, len(names) + 1) if f"A{i}" != got[3]]


def test_ids_that_the_catalog_lacks():
    wanted = "SELECT 'q' AS query, 'b' AS own_brand, 'x' AS plain, ['A1', 'A2'] AS ids"
    got = duckdb.execute(selection.choose(DUCK, wanted, "SELECT 'Z' AS uae_assetid, 1 AS nl_pos, 'z' AS nl_name")).fetchall()
    assert got == [("q", "b", "x", "A1", "Variants not found in catalog", ["A2"])]
