"""Pairs that keep arriving: bins are assigned without state, counts are kept by pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import sanitize_records
from ..plans.genome import PIXEL_KEYS, Genome, small_table
from ..sources.tasks import dealt


def stream_pairs(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A stream of new files of chrom1, pos1, chrom2, pos2 lines."""
    return spark.readStream.schema("chrom1 string, pos1 long, chrom2 string, pos2 long").option("sep", sep).option("comment", "#").csv(path)


def _placed(pairs: DataFrame, genome: Genome, binsize: int, outside: str = "raise", **options) -> DataFrame:
    """Records with their bins; those outside their sequences refused when they are computed, or dropped."""
    if outside not in ("raise", "drop"):
        raise ValueError(f"unknown action: {outside}")
    if outside == "drop":
        shift = 1 if options.get("one_based") else 0
        for k in ("1", "2"):
            sizes = small_table(pairs.sparkSession, list(genome.sizes), f"_name{k} string, _len{k} long")
            inside = (F.col(f"pos{k}") >= shift) & (F.col(f"pos{k}") < F.col(f"_len{k}") + shift)
            pairs = pairs.join(sizes, (F.col(f"chrom{k}") == F.col(f"_name{k}")) & inside).drop(f"_name{k}", f"_len{k}")
    return sanitize_records(pairs, genome, binsize=binsize, **options)


def stream_pixels(pairs: DataFrame, genome: Genome, binsize: int, **options) -> DataFrame:
    """Counts by pixel so far. Sums never close, so there is no watermark; the state is one row a nonzero pixel.
    A position outside its sequence stops the stream; ``outside="drop"`` leaves such records out."""
    rows = _placed(pairs, genome, binsize, **options)
    return rows.groupBy(*PIXEL_KEYS).agg(F.count(F.lit(1)).alias("count"))


def fold_batches(pairs: DataFrame, genome: Genome, binsize: int, folder: str, checkpoint: str, **options):
    """Write each batch's pixels as a table of its own below ``folder``; :func:`folded` sums them. A batch written twice after a failure replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        rows = _placed(batch, genome, binsize, **options)
        dealt(rows, *PIXEL_KEYS).groupBy(*PIXEL_KEYS).agg(F.count(F.lit(1)).alias("count")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return pairs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def folded(spark: SparkSession, folder: str) -> DataFrame:
    """The sum of all batches."""
    return dealt(spark.read.parquet(folder), *PIXEL_KEYS).groupBy(*PIXEL_KEYS).agg(F.sum("count").alias("count"))
