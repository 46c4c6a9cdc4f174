"""Intermediate results written once to the folder that driver and executors share.

What follows reads a small plan over a table instead of the long one that made
it, and executors that are lost lose nothing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset, as in tests."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not place:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="catalith-"))
        place = sc.getCheckpointDir()
    return place.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a written table."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state(spark: SparkSession, paths: list[str]) -> str:
    """What tells one state of some files from another: their lengths and times."""
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for s in store.listStatus(path) if store.exists(path) else []:
            out.append(f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}")
    return "\n".join(sorted(out))
