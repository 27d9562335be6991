"""Folders that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession, name: str = "work") -> str:
    """A new folder under the session's checkpoint folder.  A session on one machine (tests) that has none gets a temporary folder; on a
    cluster, where executors could not see it, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in a folder of its own, so that what is asked of it more than once is worked out once."""
    at = workspace(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)
