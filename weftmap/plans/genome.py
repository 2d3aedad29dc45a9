"""The axis: an ordered list of sequences, and what follows from it. Kept on the driver, as metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .regions import Region, parse_region

CHROMS = T.StructType([T.StructField("chrom_id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("length", T.LongType())])
BINS = T.StructType(
    [T.StructField("bin_id", T.LongType()), T.StructField("chrom_id", T.IntegerType()), T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)
PIXEL_KEYS = ("bin1_id", "bin2_id")


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Metadata of the driver as a frame whose size Spark knows, so that its joins are planned by that size."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    columns = list(zip(*rows)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds))


@dataclass(frozen=True)
class Genome:
    """Names and lengths in enumeration order."""

    sizes: tuple[tuple[str, int], ...]

    @classmethod
    def of(cls, sizes: Mapping[str, int]) -> Genome:
        return cls(tuple((n, int(x)) for n, x in sizes.items()))

    @cached_property
    def chromsizes(self) -> dict[str, int]:
        return dict(self.sizes)

    @cached_property
    def ids(self) -> dict[str, int]:
        return {n: i for i, (n, _) in enumerate(self.sizes)}

    @property
    def total(self) -> int:
        return sum(x for _, x in self.sizes)

    def chroms(self, spark: SparkSession) -> DataFrame:
        return small_table(spark, [(i, n, x) for i, (n, x) in enumerate(self.sizes)], CHROMS)

    def region(self, region: Region) -> tuple[str, int, int]:
        return parse_region(region, self.chromsizes)

    def fixed_offsets(self, binsize: int) -> list[int]:
        """First bin of every sequence under a fixed bin size, and the number of bins at the end."""
        out = [0]
        for _, length in self.sizes:
            out.append(out[-1] + -(-length // binsize))
        return out

    def fixed_extent(self, region: Region, binsize: int) -> tuple[int, int]:
        """Half-open range of fixed bins that a region touches."""
        name, start, end = self.region(region)
        first = self.fixed_offsets(binsize)[self.ids[name]]
        return first + start // binsize, first + -(-end // binsize)
