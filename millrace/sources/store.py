"""Tables written once to a folder that all executors share, and read back: streams as they are stored, and steps that several
later ones read, so that none is computed twice and a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, in the warehouse, or, on one machine, a temporary folder."""
    given = spark.sparkContext.getConf()
    base = given.get("spark.checkpoint.dir", None)
    if not base:
        alone = given.get("spark.master", "local").startswith("local") and "cluster" not in given.get("spark.master", "")
        base = f"file://{tempfile.mkdtemp(prefix='millrace-')}" if alone else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def store(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as the Parquet table at path (by default a new one)."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
