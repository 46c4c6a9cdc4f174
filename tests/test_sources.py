"""Lists, catalogs, mappings and results: golden files read and written."""

import pytest

from catalith.sources import headers, listings, stores

COLUMNS = [
    (["manufacturer", "name", "type"], ("manufacturer", "type", "name", None)),
    (["Brand", "Foxway Product Name ", "Category"], ("Brand", "Category", "Foxway Product Name ", None)),
    (["id", "product_slug", "product_name", "url"], (None, None, "product_name", None)),
    (["OEM", "Model Number", "Model", "Capacity"], ("OEM", None, "Model", "Capacity")),
    (["DEVICE TYPE", "Make", "Device"], ("Make", "DEVICE TYPE", "Device", None)),
    (["type", "grade"], (None, "type", "grade", None)),
    (["type"], (None, "type", "type", None)),
    (["price", "Item", "Memory size"], (None, None, "Item", "Memory size")),
    ([], (None, None, None, None)),
]


@pytest.mark.parametrize(("columns", "want"), COLUMNS)
def test_roles_of_columns(columns, want):
    found = headers.roles(columns)
    assert (found.brand, found.category, found.name, found.storage) == want


def test_rows_of_headers():
    assert headers.header_row([["Title", None], [None, None], ["Brand", "Name"], ["a", "b"]]) == 2
    assert headers.header_row([["Brand", "Name"]]) == 0
    assert headers.header_row([[None, 1.0], ["x", None]]) == 1
    assert headers.headers([None, "", " Brand ", "Name"], 5) == (["Brand", "Name", "col_2"], 2)
    assert headers.is_catalog_sheet("NL List 2024") and headers.is_catalog_sheet("Master data") and not headers.is_catalog_sheet("List 1")
    assert headers.url_column(["a", "Product_URL"]) == "Product_URL"
    assert headers.first_existing(["b", "c"], ["a", "c", "b"]) == "c"
    assert headers.named_columns(["a", "Unnamed: 0", " "]) == ["a"]


def test_a_csv_list_is_read(spark, tmp_path):
    path = tmp_path / "Offers.csv"
    path.write_text('Unnamed: 0,Brand,Product Name,Capacity\n0,Acer,Nitro V - Custom configuration,\n1,Acer,"Acer Nitro V - Core i5, 16GB",512GB\n2,HP,Laptop X - Custom configuration,\n3,HP,,1TB\n')
    found = listings.read_listing(spark, str(path))["Offers"]
    assert (found.roles.brand, found.roles.name, found.roles.storage) == ("Brand", "Product Name", "Capacity")
    assert found.rows.columns == ["Brand", "Product Name", "Capacity"]
    assert sorted(r["Product Name"] for r in found.rows.collect()) == ["Acer Nitro V - Core i5, 16GB", "Laptop X - Custom configuration"]


def test_names_come_from_links(spark, tmp_path):
    path = tmp_path / "Links.csv"
    path.write_text("url,grade\nhttps://a.example/p/iphone-15-plus-128gb-blauw,A\nhttps://a.example/p/galaxy-s23-256gb,B\nnothing,B\n")
    found = listings.read_listing(spark, str(path))["Links"]
    assert found.roles.name == "product_name"
    assert sorted(r.product_name for r in found.rows.collect()) == ["", "galaxy s23 256gb", "iphone 15 plus 128gb"]
    few = spark.createDataFrame([("x", "iPhone"), ("y", "iPad"), ("https://a.example/p/galaxy-s23", "Z")], "link string, name string")
    assert listings.prepared(few, "s").roles.name == "name"


def test_a_folder_of_sheets_is_read(spark, tmp_path):
    (tmp_path / "List 1.csv").write_text("Stock of May,,\n,manufacturer,name\n,Apple,iPhone 14\n,Dell,Latitude 5420\n")
    (tmp_path / "NL List.csv").write_text("a,b\n1,2\n")
    (tmp_path / "Empty.csv").write_text("")
    found = listings.read_workbook(spark, str(tmp_path))
    assert list(found) == ["List 1"]
    assert sorted(tuple(r) for r in found["List 1"].rows.collect()) == [("Apple", "iPhone 14"), ("Dell", "Latitude 5420")]
    (tmp_path / "catalog.csv").write_text("Catalog,,,,\n,category,brand,id,name\n,Mobile,Apple,A1,iPhone 14\n,Tablet,Apple,A2,\"iPad, 10.9\"\n")
    rows = listings.read_catalog_sheet(spark, str(tmp_path / "catalog.csv")).collect()
    assert [tuple(r) for r in rows] == [("Mobile", "Apple", "A1", "iPhone 14"), ("Tablet", "Apple", "A2", "iPad, 10.9")]


def test_references_are_kept(spark, tmp_path):
    place = str(tmp_path / "reference")
    assert not stores.reference_exists(spark, place) and stores.load_reference(spark, place) is None
    stores.save_reference(spark.createDataFrame([("A1", "x")], "uae_assetid string, nl_name string"), {"final": 1, "é": "ü"}, place)
    rows, stats = stores.load_reference(spark, place)
    assert rows.count() == 1 and stats == {"final": 1, "é": "ü"}
    stores.delete_reference(spark, place)
    assert not stores.reference_exists(spark, place)


def test_mapping_tells_ambiguous_ids(spark):
    rows = spark.createDataFrame([("A1", " M1"), ("A1", "M1 "), ("A2", "M2"), ("A2", "M3"), ("", "M4"), ("A3", None)], "uae string, mms string")
    got = {r.own: (r.status, r.other_id, r.others) for r in stores.load_mapping(rows, "uae", "mms").collect()}
    assert got == {"A1": ("FOUND", "M1", ["M1"]), "A2": ("AMBIGUOUS", "M2", ["M2", "M3"])}


def test_results_are_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "L1", "MATCHED", True, 0.0, "iphone"), (2, "L1", "NO_MATCH", False, 0.0, "odd iphone"), (3, "L2", "REVIEW_REQUIRED", False, 5.0, "x"), (4, "L2", "NO_MATCH", False, 0.0, "watch")], "row_id long, source_sheet string, match_status string, auto_selected boolean, review_priority double, original_input string")
    sheets = stores.result_sheets(rows)
    stores.save_results(sheets, str(tmp_path / "out"))
    assert {n: spark.read.parquet(f"{tmp_path}/out/{n}").count() for n in sheets} == {"Matched": 1, "Unmatched": 2, "Review": 1, "Auto-Selected": 1}
    stores.export_diagnostics(rows, str(tmp_path / "report"))
    assert stores.load_diagnostics(spark, str(tmp_path / "report")).count() == 4
    assert {r.sheet: r["count"] for r in spark.read.option("header", True).csv(f"{tmp_path}/report/by_sheet").groupBy("sheet").count().collect()} == {"L1": 2, "L2": 2}
    missing = stores.missing_products(rows, {"Mobile Phone": "iphone", "Smartwatch": "watch"})
    assert sorted(tuple(r) for r in missing.collect()) == [("Mobile Phone", "odd iphone"), ("Smartwatch", "watch")]
    assert stores.sample_template(spark).count() == 5
