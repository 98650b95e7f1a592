"""The folder that driver and executors share, and frames written there once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a folder of our own only where that is unset and everything runs on one machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/haetae-shared"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def addressed(spark: SparkSession, path: str) -> str:
    """``path`` (made, if it isn't there) as an address that holds without Spark as well.

    A bare path is one in the session's default file system, as Spark takes it, and a mount that only Hadoop's file systems follow (viewfs://) is followed.
    """
    context = spark.sparkContext
    there = context._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(there)
    return system.resolvePath(there).toString()


def new_folder(spark: SparkSession, name: str) -> str:
    """The address of a folder in the shared folder, by a name that nothing else has."""
    return f"{addressed(spark, shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` worked out once into the shared folder; a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
