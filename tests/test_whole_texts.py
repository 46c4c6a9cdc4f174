"""Operators over free text read whole documents of every language."""

from catalith.operators import scalars

FILL = "lorem ipsum " * 60
ROWS = [
    (1, f"{FILL}apple ipad pro", "en", "tablet"),
    (2, f"{FILL}galaxy watch 4 44 mm", "fr", "watch"),
    (3, f"{FILL}dell latitude 5420", None, "laptop"),
    (4, f"{FILL}redmi note 12 64 GB", "es", "mobile"),
    (5, f"{FILL}ñmi", "es", "other"),  # no word 'mi': the reference's \b knows letters with marks
    (6, "table", "de", "other"),
]


def test_no_prefix_and_no_language_is_left_out(spark, tmp_path):
    spark.createDataFrame([r[:3] for r in ROWS], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.category for r in scalars.PLANS["a1_category_text"].spark(spark, str(tmp_path)).collect()}
    assert got == {i: want for i, _, _, want in ROWS}
    norm = {r.doc_id: r.norm for r in scalars.PLANS["n13_normalize_text"].spark(spark, str(tmp_path)).collect()}
    assert len(norm) == len(ROWS) and all(n.startswith(FILL.strip()) for i, n in norm.items() if i < 6)
    assert norm[4].endswith("redmi note 12 64gb") and norm[2].endswith("44mm")
