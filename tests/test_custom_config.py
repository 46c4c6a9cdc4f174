"""Custom configurations that a more specific name makes superfluous."""

import duckdb

from catalith.functions.dialect import DUCK, SPARK
from catalith.operators import catalog

NAMES = [
    (1, "Nitro V - Custom configuration"),  # in 3, though not at its start
    (2, "HP Laptop X - Custom configuration"),  # in no other name
    (3, "Acer Nitro V Core i5"),
    (7, "Acer Nitro V Core i5"),  # no custom configuration, whatever its key
    (8, "Swift Custom Configuration"),  # in 9, within a word
    (9, "MegaSwift 3"),
    (10, "V1 - Custom configuration"),
    (11, "Yoga Slim 7 Carbon - Custom configuration"),  # 12 only says so too
    (12, "Yoga Slim 7 Carbon OLED - Custom Configuration"),
    (13, "custom configuration"),  # no base
    (14, "ThinkPad T14 Gen 4 custom configuration"),
    (15, "Lenovo ThinkPad T14 Gen 4 i7"),
]


def plain():
    kept = []
    for i, name in NAMES:
        if "custom configuration" in name.lower():
            base = name.split(" - Custom")[0] if " - custom" in name.lower() else name.replace("custom configuration", "").replace("Custom Configuration", "")
            if any(base.strip().lower() in n.lower() for _, n in NAMES if "custom configuration" not in n.lower()):
                continue
        kept.append((i, name))
    return kept


def test_custom_configurations(spark):
    assert [i for i, _ in plain()] == [2, 3, 7, 9, 10, 11, 12, 15]
    spark.createDataFrame(NAMES, "nl_pos long, nl_name string").createOrReplaceTempView("custom_names")
    assert sorted(map(tuple, spark.sql(catalog.custom_config(SPARK, "SELECT * FROM custom_names")).collect())) == plain()
    con = duckdb.connect()
    con.execute("CREATE TABLE custom_names (nl_pos BIGINT, nl_name VARCHAR)")
    con.executemany("INSERT INTO custom_names VALUES (?, ?)", NAMES)
    assert sorted(con.execute(catalog.custom_config(DUCK, "SELECT * FROM custom_names")).fetchall()) == plain()
