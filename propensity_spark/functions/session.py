"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = getattr(spark.sparkContext, "_propensity_dir", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="propensity-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext._propensity_dir = folder
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared folder for one run."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and cut its lineage there, so a lost executor loses no result."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
