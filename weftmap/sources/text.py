"""Text inputs with explicit schemas: pairs, triples, BG2, BED, sequence sizes and FASTA."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bins import binnify, bins_from_edges
from ..operators.ingest import one_orientation
from ..plans.genome import Genome
from ..plans.regions import natural_sorted, parse_number
from .bgzf import read_bgzf

#: Types that a field may be given, and what they are here.
_TYPES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "int": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float16": "float", "float32": "float", "float64": "double", "float": "double", "bool": "boolean", "str": "string",
}


def sql_type(dtype: str) -> str:
    """A numpy type's name as Spark's."""
    if dtype not in _TYPES:
        raise ValueError(f"unknown type: {dtype}")
    return _TYPES[dtype]


def parse_field(spec: str) -> tuple[str, int | None, str | None, str | None]:
    """``name[=column][:dtype=...,agg=...]`` as name, 1-based column, type and aggregate."""
    head, _, tail = spec.partition(":")
    name, _, number = head.partition("=")
    if not name or (number and not number.isdigit()) or number == "0":
        raise ValueError(f"not a field: {spec!r}")
    options = dict(p.split("=", 1) if "=" in p else (p, "") for p in tail.split(",") if p)
    if unknown := set(options) - {"dtype", "agg"}:
        raise ValueError(f"unknown field options: {sorted(unknown)}")
    if "dtype" in options:
        sql_type(options["dtype"])
    return name, int(number) if number else None, options.get("dtype"), options.get("agg")


def read_columns(spark: SparkSession, path: str, columns: Mapping[str, tuple[int, str]], comment: str = "#", sep: str = "\t", blocks: bool = False) -> DataFrame:
    """Named 1-based columns of a delimited text, cast to Spark types; lines that begin with ``comment`` are skipped. Compressed files are read
    by extension, each by one task, or, with ``blocks``, as block-compressed ones by several."""
    lines = (read_bgzf(spark, path) if blocks else spark.read.text(path)).where(~F.col("value").startswith(comment) & (F.length("value") > 0))
    cells = F.split("value", re.escape(sep), -1)
    return lines.select(*(cells.getItem(n - 1).cast(t).alias(c) for c, (n, t) in columns.items()))


def read_pairs(spark: SparkSession, path: str, c1: int = 1, p1: int = 2, c2: int = 3, p2: int = 4, fields: Mapping[str, tuple[int, str]] | None = None, comment: str = "#", sep: str = "\t", blocks: bool = False) -> DataFrame:
    """chrom1, pos1, chrom2, pos2 and further fields, from any column order."""
    core = {"chrom1": (c1, "string"), "pos1": (p1, "bigint"), "chrom2": (c2, "string"), "pos2": (p2, "bigint")}
    return read_columns(spark, path, {**core, **(fields or {})}, comment, sep, blocks)


def read_indexed_pairs(spark: SparkSession, path: str, index: str = "pairix", **columns) -> DataFrame:
    """Pairs of a block-compressed file that was sorted and indexed. Its index is not needed, as all blocks are read, several at a time; of a
    ``pairix`` file two sequences may occur in one order only, which is checked."""
    if index not in ("tabix", "pairix"):
        raise ValueError(f"unknown index: {index}")
    pairs = read_pairs(spark, path, blocks=True, **columns)
    return one_orientation(pairs) if index == "pairix" else pairs


def read_coo(spark: SparkSession, path: str, fields: Mapping[str, tuple[int, str]] | None = None, comment: str = "#") -> DataFrame:
    """bin1_id, bin2_id and values, by default the third column as count."""
    return read_columns(spark, path, {"bin1_id": (1, "bigint"), "bin2_id": (2, "bigint"), **(fields or {"count": (3, "bigint")})}, comment)


def read_bg2(spark: SparkSession, path: str, fields: Mapping[str, tuple[int, str]] | None = None, comment: str = "#") -> DataFrame:
    """chrom1, start1, end1, chrom2, start2, end2 and values, by default the seventh column as count."""
    core = {"chrom1": (1, "string"), "start1": (2, "bigint"), "end1": (3, "bigint"), "chrom2": (4, "string"), "start2": (5, "bigint"), "end2": (6, "bigint")}
    return read_columns(spark, path, {**core, **(fields or {"count": (7, "bigint")})}, comment)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end of a BED file; header lines, whose start is no number, are skipped."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^[^\t#]+\t[0-9]+\t[0-9]+"))
    cells = F.split("value", "\t")
    return lines.select(cells[0].alias("chrom"), cells[1].cast("bigint").alias("start"), cells[2].cast("bigint").alias("end"))


def read_chromsizes(spark: SparkSession, path: str, patterns: Sequence[str] = (r"^chr[0-9]+$", r"^chr[XY]$", r"^chrM$"), all_names: bool = False) -> Genome:
    """Names and lengths: in the file's order, or those that match the patterns, by pattern and then in natural order."""
    rows = [line["value"].split("\t")[:2] for line in spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\r?\n")).alias("value")).collect() if "\t" in line["value"]]
    sizes = {name: int(length) for name, length in rows}
    if all_names:
        return Genome.of(sizes)
    names: list[str] = []
    for pattern in patterns:
        names += [n for n in natural_sorted([n for n in sizes if re.search(pattern, n)]) if n not in names]
    return Genome.of({n: sizes[n] for n in names})


def fetch_chromsizes(db: str) -> Genome:
    """Sizes from a public server: not offered, as jobs should not depend on one."""
    raise NotImplementedError(f"download the sizes of {db} and use read_chromsizes")


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """(name, sequence) records of FASTA files; a file is read by one task, record by record."""
    if not paths:
        raise ValueError("no FASTA file given")

    def records(batches):
        import pandas as pd

        for batch in batches:
            for text in batch["value"]:
                for record in text.split(">")[1:]:
                    head, _, body = record.partition("\n")
                    yield pd.DataFrame({"name": [head.split()[0]], "sequence": ["".join(body.split())]})

    return spark.read.text(list(paths), wholetext=True).mapInPandas(records, "name string, sequence string")


def read_hic_arrays(rows: DataFrame, genome: Genome, chrom1: str = "chrms1", cut1: str = "cuts1", chrom2: str = "chrms2", cut2: str = "cuts2") -> DataFrame:
    """Pairs given as parallel columns of sequence numbers and positions; an upper triangle is required, an order is not."""
    named = rows.select(F.col(chrom1).alias("chrom1"), F.col(cut1).cast("bigint").alias("pos1"), F.col(chrom2).alias("chrom2"), F.col(cut2).cast("bigint").alias("pos2"))
    if named.where((F.col("chrom1") > F.col("chrom2")) | ((F.col("chrom1") == F.col("chrom2")) & (F.col("pos1") > F.col("pos2")))).take(1):
        raise ValueError("a pair has its sides in the wrong order")
    return named


def parse_bins(spark: SparkSession, spec: str) -> tuple[Genome, DataFrame, int | None]:
    """``sizes-file:binsize`` or a BED file of bins, as genome, bin table and fixed size."""
    path, colon, size = spec.rpartition(":")
    if colon and re.fullmatch(r"[0-9.,]+[kmgKMG]?(b|bp)?", size):
        genome, n = read_chromsizes(spark, path, all_names=True), parse_number(size)
        return genome, binnify(spark, genome, n), n
    edges = read_bed(spark, spec)
    ends = edges.withColumn("n", F.monotonically_increasing_id()).groupBy("chrom").agg(F.max("end").alias("length"), F.min("n").alias("n"))  # in file order
    genome = Genome(tuple((r["chrom"], r["length"]) for r in ends.orderBy("n").collect()))
    return genome, bins_from_edges(edges, genome), None
