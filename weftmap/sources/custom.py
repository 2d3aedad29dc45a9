"""Formats of one's own: a function per partition becomes a Spark source."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Part(InputPartition):
    def __init__(self, value):
        super().__init__(value)


def register_format(spark: SparkSession, name: str, schema: str, partitions: Callable[[dict], Sequence], read: Callable[[object, dict], Iterable[tuple]]) -> None:
    """Make ``spark.read.format(name)`` read rows of ``schema``: ``partitions(options)`` lists what may be read apart, on the driver;
    ``read(partition, options)`` yields a partition's rows, on an executor."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self):
            return [_Part(p) for p in partitions(self.options)]

        def read(self, partition):
            return iter(read(partition.value, self.options))

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return Reader(dict(self.options))

    spark.dataSource.register(Source)
