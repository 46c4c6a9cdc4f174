"""Workers give back what a task has used, and take few rows at once."""

import pyarrow as pa

from catalith.llm import common, packing
from tests.llm.test_dedup_operators import documents


def test_memory_goes_back_after_a_task(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    assert list(common.tidy(lambda parts: (p for p in parts))(iter([batch, batch]))) == [batch, batch] and calls == [1]


def test_packing_takes_few_rows_at_once(spark):
    import public_tokenizers

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        rows = packing.pack(documents(spark, [(i, "some words") for i in range(3000)]), public_tokenizers.path("word_bpe_49k.json")).collect()
        assert int(spark.conf.get(name)) <= 1000 and len({r.doc_id for r in rows}) == 3000
    finally:
        spark.conf.set(name, before)
