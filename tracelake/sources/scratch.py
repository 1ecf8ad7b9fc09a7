"""Cutting lineage in iterative jobs, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``, or on a local master a new one where that is unset."""
    context = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not there:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tracelake-"))
        there = context.getCheckpointDir()
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()``; where ``spark.checkpoint.dir`` is unset, in a new folder on a local master, as in tests, and an error on a cluster."""
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tracelake-"))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back. Unlike a checkpoint it brings no constraints of the old plan along, which in a long loop take longer to plan than the work does."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
