"""Cutting lineage: intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a folder of our own is set, but only if driver and tasks are one machine:
    a cluster whose session names no shared folder is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.conf.get("spark.master", None) or spark.sparkContext.master).startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="docweave-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a written table, read back."""
    path = f"{shared_dir(df.sparkSession)}/docweave-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
