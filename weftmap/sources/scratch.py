"""Cutting a frame's lineage in iterations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .files import Files


def _folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A local one serves only where driver and executors are one process, as in tests."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "weftmap-checkpoints")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the cluster's checkpoint folder."""
    return f"{_folder(spark)}/weftmap/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, computed and saved as a table in the cluster's checkpoint folder, until :func:`dropped`.

    The planner takes the table's size from its files. ``df.checkpoint()`` keeps the estimate of the plan instead, which
    joins multiply: in iterations its digits double each time, until they fill the tasks and no number holds them.
    """
    path = scratch_path(df.sparkSession, "saved")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weftmap_saved = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the table behind a frame from :func:`checkpointed`; other frames are left as they are."""
    if path := getattr(df, "_weftmap_saved", None):
        Files(df.sparkSession).delete(path)
