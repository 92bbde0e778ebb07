"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where that is unset, as in tests."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="spark-")
    return _own_folder


def settle(df: DataFrame) -> DataFrame:
    """Write once and read back: computed a single time, with short lineage, safe when executors go."""
    path = f"{folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
