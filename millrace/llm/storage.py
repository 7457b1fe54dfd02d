"""Tables that cut lineage, written to the folder every executor shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a temporary folder (local master) or the warehouse."""
    conf = spark.sparkContext.getConf()
    if given := conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if conf.get("spark.master", "local").startswith("local") and "cluster" not in conf.get("spark.master", ""):
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="millrace-")
        return f"file://{_own[app]}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_millrace"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Later jobs scan the written columns instead of repeating the work, a lost executor loses nothing, and the planner
    knows the table's true size, so that it broadcasts small ones by its own check. The folder's retention removes them.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package when the driver runs from another folder (clusters ship it with --py-files).

    Arrow batches are held to 32 MB, so that a few very long texts in a row do not meet in one worker's memory.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
