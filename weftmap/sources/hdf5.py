"""Import of contact matrices from HDF5 containers, where h5py is installed.

A container's groups hold ``chroms`` (name, length), ``bins`` (chrom, start, end, further columns) and ``pixels`` (bin1_id, bin2_id, values) as
one-dimensional arrays. The driver reads sequences and attributes; rows are read by tasks, each a range of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.genome import Genome
from ..plans.regions import natural_sorted, parse_uri
from .collection import ContactMatrix, create

#: Rows that a task reads at once.
CHUNK_ROWS = 4_000_000
#: Spark types by the kind and size of an array's elements.
_KINDS = {"i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "u8": "bigint", "f4": "float", "f8": "double", "b1": "boolean"}


def _h5py():
    try:
        import h5py
    except ImportError as missing:
        raise ImportError("reading HDF5 containers needs h5py") from missing
    return h5py


def list_groups(path: str) -> list[str]:
    """Groups of a container that hold a matrix, in natural order."""
    found = []

    def walk(node, name: str) -> None:
        if all(k in node for k in ("chroms", "bins", "pixels")):
            found.append(name or "/")
        for key in node:
            if key not in ("chroms", "bins", "pixels", "indexes") and hasattr(node[key], "keys"):
                walk(node[key], f"{name}/{key}")

    with _h5py().File(path, "r") as f:
        walk(f, "")
    return natural_sorted(found)


def read_table(spark: SparkSession, path: str, group: str, table: str, skip: tuple[str, ...] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The numeric columns of a table, with ``row``, its row number. Executors must reach the file under the same path."""
    with _h5py().File(path, "r") as f:
        node = f[group][table]
        columns = [c for c in node if c not in skip]
        unread = [c for c in columns if node[c].dtype.str[1:] not in _KINDS]
        kinds = {c: _KINDS[node[c].dtype.str[1:]] for c in columns if c not in unread}
        n = len(node[columns[0]]) if columns else 0
    if unread:
        raise ValueError(f"columns of unknown types: {unread}")
    starts = spark.range(0, n, chunk_rows, max(1, -(-n // chunk_rows)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _h5py().File(path, "r") as f:
            node = f[group][table]
            for batch in batches:
                for lo in batch.column(0).to_pylist():
                    hi = min(n, lo + chunk_rows)
                    arrays = [pa.array(range(lo, hi), pa.int64())]
                    for c in kinds:
                        part = node[c][lo:hi]
                        arrays.append(pa.array(part.astype("i8") if part.dtype.kind in "iu" else part))
                    yield pa.RecordBatch.from_arrays(arrays, names=["row", *kinds])

    wide = {c: "bigint" if k in ("tinyint", "smallint", "int") else k for c, k in kinds.items()}
    rows = starts.mapInArrow(read, ", ".join(["row long", *(f"`{c}` {k}" for c, k in wide.items())]))
    return rows.select("row", *(F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()))


def import_matrix(spark: SparkSession, source: str, target: str, mode: str = "w") -> ContactMatrix:
    """Write a matrix of a container (``path::group``) to a folder of one's own, with all its columns."""
    path, group = parse_uri(source)
    with _h5py().File(path, "r") as f:
        node = f[group]
        names = [x.decode() if isinstance(x, bytes) else str(x) for x in node["chroms"]["name"][:]]
        genome = Genome(tuple(zip(names, (int(x) for x in node["chroms"]["length"][:]))))
        attrs = {k: v.decode() if isinstance(v, bytes) else v for k, v in dict(node.attrs).items()}
    chroms = genome.chroms(spark).select("chrom_id", F.col("name").alias("_name"))
    bins = read_table(spark, path, group, "bins")
    extra = [c for c in bins.columns if c not in ("row", "chrom", "start", "end")]
    bins = bins.join(chroms, F.col("chrom") == F.col("chrom_id")).select(F.col("row").alias("bin_id"), "chrom_id", F.col("_name").alias("chrom"), *(F.col(c).cast("bigint").alias(c) for c in ("start", "end")), *extra)
    pixels = read_table(spark, path, group, "pixels").drop("row")
    metadata = attrs.get("metadata")
    return create(target, bins, pixels, genome=genome, symmetric=attrs.get("storage-mode", "symmetric-upper") == "symmetric-upper", assembly=attrs.get("genome-assembly"), metadata=json.loads(metadata) if metadata else None, mode=mode)
