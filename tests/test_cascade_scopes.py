"""What a row is compared with in the cascade, and the ids it gets."""

from catalith.operators import cascade

CATALOG = [
    (1, "A1", "nokia", "mobile", "nokia lumia 950 blue edition"),
    (2, "A2", "nokia", "tablet", "nokia slate 10 long name"),
    (3, "A3", "apple", "mobile", "apple special phone one"),
    (4, "A4", "apple", "mobile", "apple special phone one"),
    (5, "A5", "apple", "other", "apple magic trackpad thing"),
    (6, "A6", "dell", "laptop", "dell latitude 5420 i5 8gb"),
    (7, "A7", "hp", "laptop", "hp elitebook 840 g5 i5 8gb"),
]
ASKED = [
    ("apple special phone one", "apple", "mobile"),  # all ids of the name
    ("apple special phone one", "apple", "other"),  # J5: every category of the brand
    ("apple special phone one", "nokia", "mobile"),  # J7: the category of every brand
    ("apple special phone one", "nokia", "tablet"),  # J7 keeps to the category
    ("nokia slate 10 long name", "apple", "other"),  # J7 of 'other': the whole catalog
    ("nokia slate 10 long name", "", "tablet"),  # J5 without a brand
    ("nokia slate 10 long na", "", "other"),  # 95.65, above HIGH
    ("nokia slate 10 lon", "", "other"),  # 85.71, below HIGH
    ("dell latitude 5420 i5 8gb", "hp", "laptop"),  # laptops do not fall back
    ("apple special phone one", "sony", "mobile"),  # J4
]
WANT = {0: "A3, A4", 1: "A3, A4", 2: "A3, A4", 4: "A2", 5: "A2", 6: "A2"}


def test_scopes_and_ids(spark, monkeypatch):
    frames = {"catalog_features": spark.createDataFrame(CATALOG, "nl_pos long, uae_assetid string, brand string, category string, normalized_name string"), "input_features": spark.createDataFrame(ASKED, "query string, brand string, category string")}
    monkeypatch.setattr(cascade, "_shared", lambda spark, sf_dir, name: frames[name])
    found = {(r.query, r.brand, r.category): r for r in cascade.fuzzy_best(spark, "").collect()}
    assert {k: r.asset_id for k, r in found.items()} == {ASKED[i]: ids for i, ids in WANT.items()}
    assert found[ASKED[0]].n_ids == 2 and found[ASKED[4]].n_ids == 1
    near = {(r.query, r.brand, r.category) for r in cascade.near_miss(spark, "").collect()}
    assert near == {ASKED[i] for i in (0, 1, 5, 6)}
