"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; where that is unset and all runs on this machine (tests), below a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own_dir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


@cache
def _own_dir() -> str:
    os.makedirs("/tmp/checkpoints", exist_ok=True)
    return "file://" + tempfile.mkdtemp(prefix="convomill-", dir="/tmp/checkpoints")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a Python worker takes at once: texts are long, and a batch is held on both sides of the pipe.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; from then on Python workers of this session take BATCH_ROWS rows at once at most."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
