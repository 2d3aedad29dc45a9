"""Where intermediate tables live: the shared folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_FALLBACK = "weftmap-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the setting is absent a local one is chosen if driver and executors are one process, as in tests; on a cluster it is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), _FALLBACK)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/weftmap/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path through Hadoop, so that any store works; a failure leaves it to the cluster's own cleaning."""
    with contextlib.suppress(Exception):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Lists that note the tables made while they are open, the latest last.
_NOTING: list[list[str]] = []


@contextlib.contextmanager
def noting_tables() -> Iterator[list[str]]:
    """Notes the paths of all tables made inside, so that a caller who has stored the result can delete them."""
    made: list[str] = []
    _NOTING.append(made)
    try:
        yield made
    finally:
        _NOTING.remove(made)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back, with its lineage cut.

    The table survives lost executors and stays until :func:`release`, as later results may still read it.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    for made in _NOTING:
        made.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weftmap_path = path
    return out


def path_of(df: DataFrame) -> str | None:
    """Where a frame made by :func:`materialize` lies."""
    return getattr(df, "_weftmap_path", None)


def release(df: DataFrame) -> None:
    """Delete the table behind a frame made by :func:`materialize`."""
    if path := path_of(df):
        delete_path(df.sparkSession, path)
