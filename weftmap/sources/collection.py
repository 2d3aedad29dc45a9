"""Stored matrices: a folder with Parquet tables ``chroms``, ``bins`` and ``pixels`` and an ``info.json``.

Pixels are range-partitioned and sorted by (bin1_id, bin2_id), so that a box's comparisons skip files and row groups by their
statistics. Several resolutions lie under ``resolutions/<size>``, several cells under ``cells/<name>``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bins as B
from ..operators import query as Q
from ..operators.balance import Balance
from ..operators.ingest import misplaced, strictly_rising, validate_pixels
from ..plans.genome import PIXEL_KEYS, Genome
from ..plans.regions import Region, natural_sorted, parse_uri
from ..plans.resolutions import partition
from .files import Files
from .tasks import FEW_TASKS, SORTED_ROWS, dealt, tasks_for

FORMAT, FORMAT_MANY, FORMAT_CELLS, VERSION = "weftmap", "weftmap-multires", "weftmap-cells", 1
#: Options that the Parquet writer may be given.
WRITE_OPTIONS = {"compression", "parquet.block.size", "parquet.page.size", "parquet.enable.dictionary", "maxRecordsPerFile"}


def _folder(uri: str) -> str:
    path, group = parse_uri(uri)
    return path.rstrip("/") + ("" if group == "/" else group.rstrip("/"))


def _options(options: Mapping[str, str] | None) -> dict[str, str]:
    if unknown := set(options or {}) - WRITE_OPTIONS:
        raise ValueError(f"unknown storage options: {sorted(unknown)}")
    return {"compression": "zstd", **(options or {})}


def _write(table: DataFrame, path: str, options: Mapping[str, str]) -> None:
    """Write beside the target and then swap, so that a table may be made from its own former self."""
    files, passing = Files(table.sparkSession), f"{path}.{uuid.uuid4().hex}"
    table.write.options(**options).parquet(passing)
    files.delete(path)
    files.rename(passing, path)


def _sorted_pixels(pixels: DataFrame, rows: int) -> DataFrame:
    """Sorted by ranges of some ``SORTED_ROWS`` pixels, a task and a file each, however many there are."""
    n = -(-rows // SORTED_ROWS)
    ranges = [max(n, pixels.sparkSession.sparkContext.defaultParallelism)] if n > FEW_TASKS else []
    return pixels.repartitionByRange(*ranges, *PIXEL_KEYS).sortWithinPartitions(*PIXEL_KEYS)


def _info(genome: Genome, bins: DataFrame, pixels: DataFrame, symmetric: bool, assembly: str | None, metadata) -> dict:
    size = B.binsize_of(bins)
    value = "count" if "count" in pixels.columns else None
    nnz, total = pixels.agg(F.count("*"), F.sum(value) if value else F.lit(None)).first()
    return {
        "format": FORMAT, "format-version": VERSION, "generated-by": "weftmap", "creation-date": datetime.now(timezone.utc).isoformat(timespec="seconds"), "bin-type": "fixed" if size else "variable", "bin-size": size,
        "storage-mode": "symmetric-upper" if symmetric else "square", "nchroms": len(genome.sizes), "nbins": bins.count(), "nnz": nnz, "sum": total, "genome-assembly": assembly or "unknown", "metadata": metadata,
    }


def create(
    uri: str,
    bins: DataFrame,
    pixels: DataFrame,
    *,
    genome: Genome | None = None,
    columns: Sequence[str] | None = None,
    dtypes: Mapping[str, str] | None = None,
    symmetric: bool = True,
    assembly: str | None = None,
    metadata=None,
    mode: str = "w",
    bounds: bool = True,
    upper: bool = True,
    duplicates: bool = True,
    storage: Mapping[str, str] | None = None,
    presorted: str | None = None,
) -> ContactMatrix:
    """Write a matrix. ``columns`` (by default all values) are stored, in ``dtypes`` where given. With mode ``w`` the whole path is replaced, with
    ``a`` only the group. Pixels are checked: ids in bounds, above the diagonal if ``symmetric``, none twice.

    Everything is written beside the target first, and checked there; what the target held is replaced only then. So a matrix may be written over
    itself, and a refused one changes nothing. A path that holds the sources of the new matrix in another group is not replaced, but refused.

    ``presorted`` is a folder that holds just these pixels as a stored matrix does: where its files are sorted they are copied, and checked all the same.
    """
    spark, options = bins.sparkSession, _options(storage)
    if missing := {"bin_id", "chrom_id", "chrom", "start", "end"} - set(bins.columns):
        raise ValueError(f"bin table without {sorted(missing)}")
    columns = [c for c in pixels.columns if c not in PIXEL_KEYS] if columns is None else list(columns)
    if missing := [c for c in (*PIXEL_KEYS, *columns) if c not in pixels.columns]:
        raise ValueError(f"pixels without {missing}")
    if mode not in ("w", "a"):
        raise ValueError(f"unknown mode: {mode}")
    genome = genome or B.chromsizes_of(bins)
    kinds = {c: (dtypes or {}).get(c) for c in columns}
    stored = pixels.select(*(F.col(k).cast("long").alias(k) for k in PIXEL_KEYS), *(F.col(c).cast(t).alias(c) if t else F.col(c) for c, t in kinds.items()))
    if not duplicates:
        stored = dealt(stored, *PIXEL_KEYS).groupBy(*PIXEL_KEYS).agg(*(F.sum(c).alias(c) for c in columns))
    files = Files(spark)
    _spare_sources(files, uri, mode, bins, pixels)
    passing = f"{parse_uri(uri)[0].rstrip('/')}.{uuid.uuid4().hex}"
    try:
        _write(bins.repartitionByRange("bin_id").sortWithinPartitions("bin_id"), f"{passing}/bins", options)
        saved = spark.read.parquet(f"{passing}/bins")
        _write(genome.chroms(spark).coalesce(1), f"{passing}/chroms", options)
        places = {"n_bins": saved.count(), "bounds": bounds, "upper": symmetric and upper}
        if presorted is not None:
            files.copy(presorted, f"{passing}/pixels")
        rising = presorted is not None and strictly_rising(spark.read.parquet(f"{passing}/pixels"))
        if rising:
            _count_placed(spark.read.parquet(f"{passing}/pixels"), **places)
        else:
            # The input is computed once; checks and the sampling of ranges read what was written.
            stored.write.options(**options).parquet(f"{passing}/raw")
            raw = spark.read.parquet(f"{passing}/raw")
            rows = _count_placed(raw, **places)
            _write(_sorted_pixels(raw, rows), f"{passing}/pixels", options)
            files.delete(f"{passing}/raw")
        written = spark.read.parquet(f"{passing}/pixels")
        if duplicates and not rising and not strictly_rising(written):
            validate_pixels(written, **{**places, "bounds": False, "upper": False})
        info = json.dumps(_info(genome, saved, written, symmetric, assembly, metadata), indent=1)
        _publish(files, passing, uri, mode, info)
    finally:
        files.delete(passing)
    return ContactMatrix(spark, uri)


def _count_placed(pixels: DataFrame, n_bins: int, bounds: bool, upper: bool) -> int:
    """How many pixels there are, in one pass that refuses misplaced ones."""
    rows, bad = pixels.agg(F.count("*"), F.max(misplaced(n_bins, bounds, upper))).first()
    if bad:
        validate_pixels(pixels, n_bins, bounds=bounds, upper=upper, duplicates=False)  # tells examples
    return rows


def _spare_sources(files: Files, uri: str, mode: str, *inputs: DataFrame) -> None:
    """Refuse to replace a path if an input lies in it outside the target's own tables."""
    path, folder = parse_uri(uri)[0], _folder(uri)
    if not files.exists(path):
        return
    own = [f"{files.qualified(folder)}/{t}/" for t in ("chroms", "bins", "pixels")]
    lost = [f"{files.qualified(path)}/"] if mode == "w" else []
    for name in (x for frame in inputs for x in frame.inputFiles()):
        name = files.qualified(name)
        if any(name.startswith(p) for p in lost) and not any(name.startswith(p) for p in own):
            raise ValueError(f"{path} holds a source of {uri}; mode 'a' keeps it")


def _publish(files: Files, passing: str, uri: str, mode: str, info: str) -> None:
    """Put the tables at ``passing`` in the target's place, its info last."""
    path, folder = parse_uri(uri)[0].rstrip("/"), _folder(uri)
    if mode == "w" and folder != path:
        files.delete(path)
    for name in ("link.json", "info.json", "chroms", "bins", "pixels"):
        files.delete(f"{folder}/{name}")
    for name in ("chroms", "bins", "pixels"):
        files.rename(f"{passing}/{name}", f"{folder}/{name}")
    files.write(f"{folder}/info.json", info)


def create_cells(uri: str, bins: DataFrame, pixels: DataFrame, *, cell: str = "cell", genome: Genome | None = None, cell_bins: DataFrame | None = None, assembly: str | None = None, metadata=None, storage: Mapping[str, str] | None = None) -> None:
    """Write one matrix a cell over shared bins: pixels have a column naming the cell, ``cell_bins`` may hold (cell, bin_id, extra columns).

    All cells' pixels are one table, sorted by cell, so that a cell is read by the statistics of files and row groups, however many cells there are.
    The tables are written beside the target and then put in its place. The info names the cells, a string a cell.
    """
    spark, options = bins.sparkSession, _options(storage)
    folder, files, genome = _folder(uri), Files(bins.sparkSession), genome or B.chromsizes_of(bins)
    passing = f"{folder}.{uuid.uuid4().hex}"
    try:
        _write(genome.chroms(spark).coalesce(1), f"{passing}/chroms", options)
        _write(bins.repartitionByRange("bin_id").sortWithinPartitions("bin_id"), f"{passing}/bins", options)
        keys = (cell, *PIXEL_KEYS)
        _write(pixels.repartitionByRange(*keys).sortWithinPartitions(*keys), f"{passing}/cells", options)
        if cell_bins is not None:
            _write(cell_bins.repartitionByRange(cell, "bin_id").sortWithinPartitions(cell, "bin_id"), f"{passing}/cell_bins", options)
        names = [str(r[0]) for r in spark.read.parquet(f"{passing}/cells").select(cell).distinct().orderBy(cell).collect()]
        info = {"format": FORMAT_CELLS, "format-version": VERSION, "ncells": len(names), "cells": names, "cell-column": cell, "nchroms": len(genome.sizes), "nbins": spark.read.parquet(f"{passing}/bins").count(), "bin-size": B.binsize_of(bins), "genome-assembly": assembly or "unknown", "metadata": metadata}
        files.write(f"{passing}/info.json", json.dumps(info, indent=1))
        files.delete(folder)
        files.rename(passing, folder)
    finally:
        files.delete(passing)


def read_cell(spark: SparkSession, uri: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(bins, pixels) of one cell, with the cell's own bin columns."""
    folder, files = _folder(uri), Files(spark)
    info = json.loads(files.read(f"{folder}/info.json"))
    if name not in info["cells"]:
        raise KeyError(f"no cell {name!r}; there are {info['cells'][:20]}")
    key = info["cell-column"]
    bins = spark.read.parquet(f"{folder}/bins")
    if files.exists(f"{folder}/cell_bins"):
        own = spark.read.parquet(f"{folder}/cell_bins").where(F.col(key).cast("string") == name).drop(key)
        bins = bins.join(own, "bin_id", "left")
    return bins, spark.read.parquet(f"{folder}/cells").where(F.col(key).cast("string") == name).drop(key)


def list_matrices(spark: SparkSession, path: str) -> list[str]:
    """Groups below a path that hold a matrix, in natural order."""
    files, found = Files(spark), []

    def walk(folder: str, group: str) -> None:
        if _format(files, folder) == FORMAT:
            found.append(group or "/")
        for name in files.names(folder):
            if name not in ("chroms", "bins", "pixels", "cells", "cell_bins") and files.is_dir(f"{folder}/{name}"):
                walk(f"{folder}/{name}", f"{group}/{name}")

    walk(path.rstrip("/"), "")
    return natural_sorted(found)


def list_cells(spark: SparkSession, uri: str) -> list[str]:
    return natural_sorted(json.loads(Files(spark).read(f"{_folder(uri)}/info.json"))["cells"])


def _format(files: Files, folder: str) -> str | None:
    if not files.exists(f"{folder}/info.json"):
        return None
    return json.loads(files.read(f"{folder}/info.json")).get("format")


def is_matrix(spark: SparkSession, uri: str) -> bool:
    files, folder = Files(spark), _folder(uri)
    return _format(files, folder) == FORMAT and all(files.exists(f"{folder}/{t}") for t in ("chroms", "bins", "pixels"))


def is_multires(spark: SparkSession, path: str) -> bool:
    return Files(spark).is_dir(f"{path.rstrip('/')}/resolutions")


def is_cells(spark: SparkSession, path: str) -> bool:
    return _format(Files(spark), path.rstrip("/")) == FORMAT_CELLS


def resolve(spark: SparkSession, uri: str) -> str:
    """The folder of a matrix, through links."""
    files, folder, seen = Files(spark), _folder(uri), set()
    while files.exists(f"{folder}/link.json"):
        if folder in seen:
            raise OSError(f"{uri} links in a circle")
        seen.add(folder)
        folder = json.loads(files.read(f"{folder}/link.json"))["target"]
    return folder


def copy(spark: SparkSession, source: str, target: str, *, overwrite: bool = False, link: bool = False, rename: bool = False, soft: bool = False) -> None:
    """Copy a matrix, move it (``rename``), or write a link to it: ``soft`` by any path, ``link`` within one container only."""
    if sum((link, rename, soft)) > 1:
        raise ValueError("at most one of link, rename and soft")
    files, old, new = Files(spark), _folder(source), _folder(target)
    if link and parse_uri(source)[0] != parse_uri(target)[0]:
        raise OSError("a hard link cannot leave its container")
    if not files.exists(old):
        raise KeyError(f"nothing at {source}")
    if files.exists(new):
        if not overwrite:
            raise ValueError(f"{target} exists")
        files.delete(new)
    if rename:
        files.rename(old, new)
    elif link or soft:
        files.write(f"{new}/link.json", json.dumps({"target": old}))
    else:
        files.copy(old, new)


def tree(spark: SparkSession, path: str, level: int | None = None) -> str:
    """The folders and tables of a container, indented."""
    files, lines = Files(spark), [path.rstrip("/").rpartition("/")[2] or "/"]

    def walk(folder: str, depth: int) -> None:
        if level is not None and depth > level:
            return
        for name in natural_sorted([n for n in files.names(folder) if not n.startswith((".", "_", "part-")) and files.is_dir(f"{folder}/{n}")]):
            lines.append("  " * depth + name)
            if name in ("chroms", "bins", "pixels"):
                if level is None or depth < level:
                    lines.extend("  " * (depth + 1) + f"{f.name}: {f.dataType.simpleString()}" for f in spark.read.parquet(f"{folder}/{name}").schema)
            else:
                walk(f"{folder}/{name}", depth + 1)

    walk(path.rstrip("/"), 1)
    return "\n".join(lines)


def attributes(spark: SparkSession, uri: str) -> str:
    """The info of a group as ``key: value`` lines."""
    return "\n".join(f"{k}: {json.dumps(v)}" for k, v in json.loads(Files(spark).read(f"{resolve(spark, uri)}/info.json")).items())


class RangeSelector:
    """Rows of a numbered table by slice or region, and some of its columns; nothing is read until the frame is used."""

    def __init__(self, frame: DataFrame, key: str, n: int, extent, columns: Sequence[str] | None = None):
        self.frame, self.key, self.n, self.extent, self._columns = frame, key, n, extent, columns

    @property
    def columns(self) -> list[str]:
        return list(self._columns or self.frame.columns)

    @property
    def dtypes(self) -> dict[str, str]:
        kinds = dict(self.frame.dtypes)
        return {c: kinds[c] for c in self.columns}

    def keys(self) -> list[str]:
        return self.columns

    def __len__(self) -> int:
        return self.n

    @property
    def shape(self) -> tuple[int, int]:
        return self.n, len(self.columns)

    def __contains__(self, column: str) -> bool:
        return column in self.columns

    def _rows(self, lo: int | None, hi: int | None) -> DataFrame:
        out = Q.slice_rows(self.frame, self.key, lo, hi)
        return out.select(*self._columns) if self._columns else out

    def __getitem__(self, at):
        if isinstance(at, str):
            return RangeSelector(self.frame, self.key, self.n, self.extent, [at])
        if isinstance(at, (list, tuple)) and all(isinstance(c, str) for c in at):
            return RangeSelector(self.frame, self.key, self.n, self.extent, list(at))
        lo, hi = slice_bounds(at, self.n)
        return self._rows(lo, hi)

    def fetch(self, region: Region) -> DataFrame:
        return self._rows(*self.extent(region))


def slice_bounds(at, n: int) -> tuple[int, int]:
    """A slice of step 1, or one index, as a half-open range; negatives count from the end."""
    if isinstance(at, slice):
        if at.step not in (None, 1):
            raise ValueError("only a step of 1 is possible")
        lo, hi = (0 if at.start is None else int(at.start)), (n if at.stop is None else int(at.stop))
        return (lo + n if lo < 0 else lo), (hi + n if hi < 0 else hi)
    i = int(at)
    i += n if i < 0 else 0
    if not 0 <= i < n:
        raise IndexError(f"{at} is out of {n} rows")
    return i, i + 1


class MatrixSelector:
    """Boxes of a matrix by slices or regions."""

    def __init__(self, matrix: ContactMatrix, field: str, balance, divisive: bool | None, as_pixels: bool, join: bool, dense: bool):
        self.matrix, self.field, self.balance, self.divisive, self.as_pixels, self.join, self.dense = matrix, field, balance, divisive, as_pixels, join, dense

    @property
    def shape(self) -> tuple[int, int]:
        return self.matrix.shape

    def box(self, bounds: Q.Box) -> DataFrame:
        m, weight = self.matrix, ("weight" if self.balance is True else self.balance or None)
        pixels = m.pixels_frame.select(*PIXEL_KEYS, self.field)
        symmetric = m.storage_mode == "symmetric-upper" and not self.as_pixels
        if weight and weight not in m.bins_frame.columns:
            raise ValueError(f"no column {weight!r} in the bin table: balance the matrix or pass balance=False")
        if self.dense:
            return Q.dense(pixels, m.bins_frame, bounds, self.field, weight, symmetric, self.divisive)
        rows = (Q.fill_lower if symmetric else Q.box)(pixels, bounds)
        if weight:
            rows = Q.balanced(rows, m.bins_frame, weight, self.divisive, self.field)
        return Q.annotate(rows, m.bins_frame, ["chrom", "start", "end"], replace=True) if self.join else rows

    def __getitem__(self, at) -> DataFrame:
        at = at if isinstance(at, tuple) else (at,)
        if len(at) > 2:
            raise IndexError("a matrix has two axes")
        n = self.matrix.shape[0]
        bounds = [slice_bounds(a, n) for a in at] + [(0, n)] * (2 - len(at))
        return self.box((*bounds[0], *bounds[1]))

    def chunks(self, bounds: Q.Box, rows: int) -> BoxChunks:
        """A box in spans of at most ``rows`` rows."""
        return BoxChunks(self, bounds, rows)

    def fetch(self, region: Region, region2: Region = None) -> DataFrame:
        rows = self.matrix.extent(region)
        return self.box((*rows, *(rows if region2 is None else self.matrix.extent(region2))))


class BoxChunks:
    """A box in spans of rows, to be fetched one by one: ``n_chunks``, ``get_chunk(i)``, iteration. Each is a frame; nothing is read before it is used."""

    def __init__(self, selector: MatrixSelector, bounds: Q.Box, rows: int):
        self.selector, self.bounds = selector, bounds
        self.spans = partition(bounds[0], bounds[1], rows)

    @property
    def n_chunks(self) -> int:
        return len(self.spans)

    __len__ = n_chunks.fget

    def get_chunk(self, i: int) -> DataFrame:
        if not 0 <= i < len(self.spans):
            raise IndexError(f"chunk {i} of {len(self.spans)}")
        return self.selector.box((*self.spans[i], *self.bounds[2:]))

    def __iter__(self):
        return (self.get_chunk(i) for i in range(len(self.spans)))


class ContactMatrix:
    """A handle on a stored matrix."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri, self.folder = spark, uri, resolve(spark, uri)
        if not is_matrix(spark, self.folder):
            raise KeyError(f"no matrix at {uri}; found {list_matrices(spark, parse_uri(uri)[0])}")
        self.refresh()

    def refresh(self) -> None:
        self.info = json.loads(Files(self.spark).read(f"{self.folder}/info.json"))
        for name in ("genome", "chroms_frame", "bins_frame", "pixels_frame"):
            self.__dict__.pop(name, None)

    def __repr__(self) -> str:
        return f"<ContactMatrix {self.uri}>"

    @cached_property
    def chroms_frame(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/chroms")

    @cached_property
    def bins_frame(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/bins")

    @cached_property
    def pixels_frame(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/pixels")

    @cached_property
    def genome(self) -> Genome:
        return Genome(tuple((r["name"], r["length"]) for r in self.chroms_frame.orderBy("chrom_id").collect()))

    @property
    def storage_mode(self) -> str:
        return self.info.get("storage-mode", "symmetric-upper")

    @property
    def binsize(self) -> int | None:
        return self.info["bin-size"]

    @property
    def chromsizes(self) -> dict[str, int]:
        return self.genome.chromsizes

    @property
    def chromnames(self) -> list[str]:
        return [n for n, _ in self.genome.sizes]

    @property
    def shape(self) -> tuple[int, int]:
        return self.info["nbins"], self.info["nbins"]

    def extent(self, region: Region) -> tuple[int, int]:
        return B.extent_of(self.bins_frame, self.genome, region, self.binsize)

    def offset(self, region: Region) -> int:
        return self.extent(region)[0]

    def chroms(self) -> RangeSelector:
        return RangeSelector(self.chroms_frame, "chrom_id", self.info["nchroms"], lambda r: (self.genome.ids[r], self.genome.ids[r] + 1))

    def bins(self) -> RangeSelector:
        return RangeSelector(self.bins_frame, "bin_id", self.info["nbins"], self.extent)

    def pixels(self, join: bool = False) -> RangeSelector:
        """Pixels by region of bin1; ``join`` replaces ids by positions."""
        frame = self.pixels_frame
        if join:
            frame = Q.annotate(frame, self.bins_frame, ["chrom", "start", "end"])
        return RangeSelector(frame, "bin1_id", self.info["nnz"], self.extent)

    def matrix(self, field: str = "count", balance: bool | str = True, *, as_pixels: bool = False, join: bool = False, dense: bool = False, divisive: bool | None = None) -> MatrixSelector:
        return MatrixSelector(self, field, balance, divisive, as_pixels, join, dense)

    def _replace(self, table: str, frame: DataFrame) -> None:
        key = {"chroms": "chrom_id", "bins": "bin_id"}.get(table)
        _write(_sorted_pixels(frame, self.info["nnz"]) if key is None else frame.repartitionByRange(key).sortWithinPartitions(key), f"{self.folder}/{table}", _options(None))
        self.refresh()

    def append(self, table: str, data: DataFrame, keys: Sequence[str] | None = None, force: bool = False) -> None:
        """Add columns to a table, by its keys; columns that exist are replaced with ``force`` only."""
        keys = list(keys or {"chroms": ["chrom_id"], "bins": ["bin_id"]}.get(table, PIXEL_KEYS))
        frame = getattr(self, f"{table}_frame")
        new = [c for c in data.columns if c not in keys]
        if clash := [c for c in new if c in frame.columns]:
            if not force:
                raise ValueError(f"columns exist: {clash}")
            frame = frame.drop(*clash)
        self._replace(table, frame.join(data, keys, "left"))

    def put(self, table: str, data: DataFrame, lo: int = 0) -> None:
        """Overwrite columns of a numbered table (chroms or bins) from row ``lo`` on: ``data`` has ``row``, counted from 0, and the columns' values. Rows that it lacks stay."""
        keys = {"chroms": "chrom_id", "bins": "bin_id"}
        if table not in keys:
            raise ValueError("pixels have no row numbers: write them anew")
        frame, key = getattr(self, f"{table}_frame"), keys[table]
        new = [c for c in data.columns if c != "row"]
        if missing := [c for c in new if c not in frame.columns]:
            raise ValueError(f"no columns {missing} to overwrite")
        patch = data.select((F.col("row") + lo).alias("_row"), *(F.col(c).alias(f"_new_{c}") for c in new))
        met = frame.join(patch, F.col(key) == F.col("_row"), "left")
        kinds = dict(frame.dtypes)
        pick = {c: F.when(F.col("_row").isNotNull(), F.col(f"_new_{c}").cast(kinds[c])).otherwise(F.col(c)) for c in new}
        self._replace(table, met.select(*(pick[c].alias(c) if c in pick else F.col(c) for c in frame.columns)))

    def delete_columns(self, table: str, columns: Sequence[str]) -> None:
        self._replace(table, getattr(self, f"{table}_frame").drop(*columns))

    def store_balance(self, balance: Balance, name: str = "weight", force: bool = False) -> None:
        """Store weights as a bin column, and how they came about in the info."""
        self.append("bins", balance.table(self.spark).withColumnRenamed("weight", name), force=force)
        stats = {k: v.tolist() if hasattr(v, "tolist") else v for k, v in balance.stats.items()}
        self.info.setdefault("columns", {})[name] = stats
        Files(self.spark).write(f"{self.folder}/info.json", json.dumps(self.info, indent=1))

    def rename_chroms(self, names: Mapping[str, str]) -> None:
        """Give sequences other names; order and ids stay."""
        after = [names.get(n, n) for n in self.chromnames]
        if len(set(after)) < len(after):
            raise ValueError("two sequences would have one name")
        renamed = lambda c: F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)).getItem(F.col(c)), F.col(c)) if names else F.col(c)
        chroms, bins = self.chroms_frame.withColumn("name", renamed("name")), self.bins_frame.withColumn("chrom", renamed("chrom"))
        self._replace("chroms", chroms)
        self._replace("bins", bins)

    def dump(self, table: str = "pixels", *, columns: Sequence[str] | None = None, region: Region = None, region2: Region = None, fill_lower: bool = False, balanced: bool = False, join: bool = False, annotate: Sequence[str] = (), one_based_ids: bool = False, one_based_starts: bool = False, field: str = "count") -> DataFrame:
        """A table or a box as flat rows, in order."""
        if table != "pixels":
            out = getattr(self, table)()
            frame = out.fetch(region) if region is not None else out[:]
            frame = Q.one_based(frame, one_based_ids, one_based_starts)
            frame = frame.orderBy("bin_id" if table == "bins" else "chrom_id")
            return frame.select(*columns) if columns else frame
        n = self.shape[0]
        rows = self.extent(region) if region is not None else (0, n)
        cols = self.extent(region2) if region2 is not None else (rows if region is not None else (0, n))
        pixels = self.pixels_frame.select(*PIXEL_KEYS, field)
        out = (Q.fill_lower if fill_lower and self.storage_mode == "symmetric-upper" else Q.box)(pixels, (*rows, *cols))
        if balanced:
            out = Q.balanced(out, self.bins_frame, value=field)
        extra = [*(["chrom", "start", "end"] if join else []), *annotate]
        if extra:
            out = Q.annotate(out, self.bins_frame, extra)
        out, n = Q.one_based(out, one_based_ids, one_based_starts), tasks_for(pixels)
        out = out.repartitionByRange(n, *PIXEL_KEYS).sortWithinPartitions(*PIXEL_KEYS) if n else out.orderBy(*PIXEL_KEYS)
        if join:
            out = out.drop(*PIXEL_KEYS)
        return out.select(*columns) if columns else out


def merge(spark: SparkSession, target: str, sources: Sequence[str], columns: Sequence[str] = ("count",), how: Mapping[str, object] | None = None, dtypes: Mapping[str, str] | None = None, mode: str = "w") -> ContactMatrix:
    """Write the merger of several matrices of one kind over the same bins; mode ``a`` keeps what else the target's path holds."""
    from ..operators.reduce import merge_pixels, same_bins

    parts = [ContactMatrix(spark, s) for s in sources]
    if len({p.storage_mode for p in parts}) > 1:
        raise ValueError("symmetric and square matrices do not merge")
    if not all(same_bins(parts[0].bins_frame, p.bins_frame) for p in parts[1:]):
        raise ValueError("the bins differ")
    bins = parts[0].bins_frame.select("bin_id", "chrom_id", "chrom", "start", "end")
    return create(target, bins, merge_pixels([p.pixels_frame for p in parts], columns, how), genome=parts[0].genome, symmetric=parts[0].storage_mode == "symmetric-upper", assembly=parts[0].info["genome-assembly"], mode=mode, dtypes=dtypes)


def coarsen(spark: SparkSession, source: str, target: str, factor: int, columns: Sequence[str] = ("count",), how: Mapping[str, object] | None = None, dtypes: Mapping[str, str] | None = None, mode: str = "w") -> ContactMatrix:
    """Write a matrix with bins of ``factor`` of the source's."""
    from ..operators.reduce import coarsen_bins, coarsen_pixels

    m = ContactMatrix(spark, source)
    return create(target, coarsen_bins(m.bins_frame, factor), coarsen_pixels(m.pixels_frame, m.bins_frame, factor, columns, how), genome=m.genome, symmetric=m.storage_mode == "symmetric-upper", assembly=m.info["genome-assembly"], mode=mode, dtypes=dtypes)


def _ready(m: ContactMatrix, columns: Sequence[str], dtypes: Mapping[str, str] | None) -> str | None:
    """The folder of a matrix's pixels if they can be stored elsewhere as they are."""
    same = m.pixels_frame.columns == [*PIXEL_KEYS, *columns] and all(dict(m.pixels_frame.dtypes)[k] == "bigint" for k in PIXEL_KEYS)
    return f"{m.folder}/pixels" if same and not dtypes else None


def zoomify(spark: SparkSession, sources: Sequence[str], path: str, resolutions: Sequence[int], columns: Sequence[str] = ("count",), how: Mapping[str, object] | None = None, dtypes: Mapping[str, str] | None = None) -> list[str]:
    """Write a multi-resolution container: every base as it is, every other resolution from its largest smaller divisor, read back from disk."""
    from ..operators.reduce import zoomify as levels

    bases = {(m := ContactMatrix(spark, s)).binsize or 1: m for s in sources}
    first = next(iter(bases.values()))
    files, passing = Files(spark), f"{path.rstrip('/')}.{uuid.uuid4().hex}"  # written beside, as the target may hold the sources

    def keep(resolution: int, level):
        saved = create(f"{passing}::/resolutions/{resolution}", level[0].select("bin_id", "chrom_id", "chrom", "start", "end"), level[1], columns=columns, genome=first.genome, symmetric=first.storage_mode == "symmetric-upper", assembly=first.info["genome-assembly"], mode="a", dtypes=dtypes, presorted=_ready(bases[resolution], columns, dtypes) if resolution in bases else None)
        return saved.bins_frame, saved.pixels_frame

    try:
        levels({r: (m.bins_frame, m.pixels_frame) for r, m in bases.items()}, resolutions, columns, how, keep)
        files.write(f"{passing}/info.json", json.dumps({"format": FORMAT_MANY, "format-version": VERSION}))
        files.delete(path)
        files.rename(passing, path.rstrip("/"))
    finally:
        files.delete(passing)
    return list_matrices(spark, path)


def zoom_levels(spark: SparkSession, source: str, path: str, columns: Sequence[str] = ("count",), how: Mapping[str, object] | None = None, dtypes: Mapping[str, str] | None = None) -> list[str]:
    """Write the factor-2 pyramid, one group a level: the deepest is the source, level 0 fits one tile."""
    from ..operators.reduce import zoom_levels as levels

    m, files, passing = ContactMatrix(spark, source), Files(spark), f"{path.rstrip('/')}.{uuid.uuid4().hex}"

    def keep(level: int, tables):
        saved = create(f"{passing}::/{level}", tables[0].select("bin_id", "chrom_id", "chrom", "start", "end"), tables[1], columns=columns, genome=m.genome, symmetric=m.storage_mode == "symmetric-upper", assembly=m.info["genome-assembly"], mode="a", dtypes=dtypes, presorted=_ready(m, columns, dtypes) if tables[1] is m.pixels_frame else None)
        return saved.bins_frame, saved.pixels_frame

    try:
        made = levels(m.bins_frame, m.pixels_frame, columns, keep=keep, how=how)
        files.write(f"{passing}/info.json", json.dumps({"format": FORMAT_MANY, "format-version": VERSION, "max-zoom": max(made)}))
        files.delete(path)
        files.rename(passing, path.rstrip("/"))
    finally:
        files.delete(passing)
    return list_matrices(spark, path)
