"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """That of checkpoints. Where none is set one is made on a single machine, as in tests; on a cluster it is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="wayline-"))
    return folder or context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder within the shared one that is not there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder; their lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
