"""The gates ask for the attributes of each text once, however many pairs share it."""

from pyspark.sql import functions as F

from catalith.functions.dialect import SPARK
from catalith.operators import cascade, matching
from catalith.plans.layers import apply_layers

QUERIES = ["apple iphone 14 pro 128gb", "apple watch series 9 45mm gps aluminium", "samsung galaxy tab s9 ultra 256gb"]
NAMES = ["apple iphone 14 128gb", "apple iphone 14 pro 128gb", "apple watch series 9 41mm gps", "samsung galaxy tab s9 256gb", ""]


def test_gates_ask_each_text_once(spark, monkeypatch):
    found = spark.createDataFrame([(q, n, i) for i in range(2) for q in QUERIES for n in NAMES], "query string, matched_on string, i int")
    asked = []
    monkeypatch.setattr(cascade, "apply_layers", lambda df, layers: asked.append((df.count(), {n.removeprefix("q_") for x in layers for n in x})) or apply_layers(df, layers))
    fields = ["query", "matched_on", "i", "gate", "verified", "most"]
    got = sorted(map(tuple, cascade._gated(found).select(*fields).collect()))
    assert [n for n, names in asked if "identity" in names] == [7]  # texts, not their 15 pairs
    layers = [*matching.pair_layers(SPARK), {"gate": matching.gate_reasons(SPARK), "verified": matching.critical_ok(SPARK), "most": matching.token_guard(SPARK)}]
    plain = apply_layers(found.withColumns({"q_norm": F.col("query"), "c_norm": F.col("matched_on")}), layers)
    assert got == sorted(map(tuple, plain.select(*fields).collect())) and len(got) == 30
    assert len({tuple(r[3]) for r in got}) > 4
