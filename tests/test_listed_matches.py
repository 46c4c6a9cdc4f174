"""Rows get the text of their list of ids last, beside others of the same list."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalith.operators import matching
from catalith.plans.query import Query

SMALL = "/root/testdata/sf0.001"


def test_each_row_gets_its_list(spark):
    held = spark.createDataFrame([(n, place, f"A{n}_{place}") for n in range(3) for place in (2, 1, 10)], "list long, place int, asset_id string")
    rows = spark.createDataFrame([(i, i % 2, "m") for i in range(400)], "row_id long, list long, method string")
    got = matching.with_lists(rows, held, task_lists=20, task_bytes=1000).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.row_id, r.mapped_ids, r.method) for r in got) == [(i, ", ".join(f"A{i % 2}_{p}" for p in (1, 2, 10)), "m") for i in range(400)]
    tasks = Counter((r.mapped_ids, r.task) for r in got)
    assert len(tasks) > 4 and max(tasks.values()) < 150  # a list of many rows is not one task
    assert not matching.with_lists(rows.limit(0), held).collect()


def test_files_name_a_long_list_once(spark, tmp_path):
    ids = [f"A{i}" for i in range(20_000)]
    held = spark.createDataFrame([(n, place, i) for n in range(4) for place, i in enumerate(ids[n:])], "list long, place int, asset_id string")
    rows = spark.range(4_000).select(F.col("id").alias("row_id"), (F.col("id") % 4).alias("list"))
    matching.with_lists(rows, held).write.parquet(str(tmp_path / "out"))
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert size < 4 * sum(len(i) + 2 for i in ids)  # 4,000 times as much in a plain file


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name, plain", [("j1_attribute", matching.attribute_matches), ("j2_signature", matching.signature_matches)])
def test_matches_shuffle_no_list_with_each_row(spark, name, plain):
    got = matching.QUERIES[name].spark(spark, SMALL)
    assert "partitioning(query" not in got._jdf.queryExecution().executedPlan().toString()
    want = Query(plain).spark(spark, SMALL)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
