"""Checkpoints for loops over DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A temporary one is used only where none is named and everything runs on one
    machine (tests); on a cluster that is an error, as executors wouldn't share it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="volmesh-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, in the folder of checkpoints."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder of checkpoints, which driver and executors share."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, whose next join is by a shuffle: Spark takes exploded or mapped rows for as few as those that they are made
    of, and would broadcast them whole through the driver."""
    return df.hint("merge")


def broadcast_if_few(df: DataFrame, most: int) -> DataFrame:
    """``df``, broadcast if a count shows at most so many rows; else, and for streams, the join is left to Spark."""
    return F.broadcast(df) if not df.isStreaming and df.limit(most + 1).count() <= most else df
