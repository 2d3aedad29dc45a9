"""How many tasks the rows of a shuffle go to.

The session's number of shuffle partitions doesn't know the input. Where it is fixed, a task's rows grow with the input; where Spark merges
small partitions, it goes by their bytes as sent, and the tables that an aggregate or a sort builds from them are many times as large.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the files behind a frame that a task has, and rows of those that tell their number: sorted pixels take a byte or two each.
TASK_BYTES, TASK_ROWS = 8 << 20, 500_000
#: Frames that need no more tasks than this are left to the session's settings.
FEW_TASKS = 4
#: Rows of a sorted pixel table in a task, and so in a file.
SORTED_ROWS = 2_000_000
#: What Spark says of a source whose size it doesn't know is far above this.
_UNKNOWN = 1 << 50
#: Bytes of a Parquet table from which on its rows are counted, and the counts by paths and bytes.
_COUNTED = 1 << 20
_KNOWN: dict[tuple[tuple[str, ...], int], int] = {}


def _rows(spark: SparkSession, leaf, size: int) -> int:
    """Rows of a Parquet table, from its files' footers; 0 for other and for small tables."""
    if size < _COUNTED or leaf.nodeName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation" or str(leaf.relation().fileFormat()) != "Parquet":
        return 0
    roots = leaf.relation().location().rootPaths()
    paths = tuple(str(roots.apply(i)) for i in range(roots.size()))
    if (paths, size) not in _KNOWN:
        if len(_KNOWN) >= 1000:
            _KNOWN.clear()
        _KNOWN[paths, size] = spark.read.parquet(*paths).count()
    return _KNOWN[paths, size]


def shares(df: DataFrame) -> int:
    """How many tasks' shares of bytes or rows the files behind the frame hold, each counted as often as it is read; 0 for sources of unknown size."""
    leaves, n = df._jdf.queryExecution().analyzed().collectLeaves(), 0.0
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        size = int(str(leaf.stats().sizeInBytes()))
        if size < _UNKNOWN:
            n += max(size / TASK_BYTES, _rows(df.sparkSession, leaf, size) / TASK_ROWS)
    return ceil(n)


def tasks_for(df: DataFrame) -> int | None:
    """Tasks for the frame's rows, so that one's share stays as it is when the input grows; None if the session's settings will do."""
    if df.isStreaming:
        return None
    n = shares(df)
    return max(n, df.sparkSession.sparkContext.defaultParallelism) if n > FEW_TASKS else None


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows, equal keys together, dealt to as many tasks as the input needs. Aggregates and joins by the keys that follow need no other shuffle."""
    n = tasks_for(df)
    return df.repartition(n, *keys) if n else df
