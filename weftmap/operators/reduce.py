"""Merging matrices and making them coarser."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import MOST_PIECES, binsize_of, chromsizes_of, piecewise, sequence_starts
from ..plans.genome import PIXEL_KEYS, small_table
from ..plans.resolutions import predecessors, quad_tile_depth
from ..sources.tasks import dealt
from .ingest import aggregate

#: Integer types in the order in which they widen.
_WIDTHS = ("byte", "short", "int", "long", "float", "double")
_NAMES = {"tinyint": "byte", "smallint": "short", "bigint": "long"}


def same_bins(a: DataFrame, b: DataFrame) -> bool:
    """Whether two bin tables cut the same sequences in the same way."""
    if chromsizes_of(a) != chromsizes_of(b):
        return False
    size = binsize_of(a)
    if size != binsize_of(b):
        return False
    if size is not None:
        return True
    keys = ("chrom_id", "chrom", "start", "end")
    return not (a.select(*keys).exceptAll(b.select(*keys)).take(1) or b.select(*keys).exceptAll(a.select(*keys)).take(1))


def common_type(kinds: Sequence[str]) -> str:
    """The narrowest of the usual numeric types that holds all the given ones."""
    ranks = [_WIDTHS.index(_NAMES.get(k, k)) for k in kinds]
    if max(ranks) == _WIDTHS.index("float") and any(_WIDTHS.index("int") <= r < _WIDTHS.index("float") for r in ranks):
        return "double"
    return _WIDTHS[max(ranks)]


def merge_pixels(tables: Sequence[DataFrame], columns: Sequence[str] = ("count",), how: Mapping[str, object] | None = None) -> DataFrame:
    """All tables' pixels, equal ones aggregated (summed by default), with each column in a type common to all."""
    how = dict(how or {})
    for t in tables:
        if missing := [c for c in columns if c not in t.columns]:
            raise ValueError(f"columns missing from an input: {missing}")
    kinds = {c: common_type([dict(t.dtypes)[c] for t in tables]) for c in columns}
    every = reduce(DataFrame.unionByName, [t.select(*PIXEL_KEYS, *(F.col(c).cast(kinds[c]).alias(c) for c in columns)) for t in tables])
    types = {f.name: f.dataType for f in every.schema}
    return dealt(every, *PIXEL_KEYS).groupBy(*PIXEL_KEYS).agg(*(aggregate(how.get(c, "sum"), c, types[c]).alias(c) for c in columns))


Starts = list[tuple[int, int, int]]


def coarser_starts(starts: Starts, factor: int) -> Starts:
    """(first bin, chrom_id, number of bins) of every sequence when its bins go in groups of ``factor``: what the coarser bins have, without computing them."""
    first, out = 0, []
    for _, chrom, n in starts:
        out.append((first, chrom, -(-n // factor)))
        first += out[-1][2]
    return out


def _coarse_pieces(starts: Starts, factor: int) -> list[tuple[int, int]]:
    """(first bin, first coarser bin) of every sequence."""
    return [(old, new) for (old, *_), (new, *_) in zip(starts, coarser_starts(starts, factor))]


def _coarser(column: str, pieces: list[tuple[int, int]], factor: int) -> Column:
    return piecewise(F.col(column), [(old, F.expr(f"{new}L + (`{column}` - {old}L) div {factor}")) for old, new in pieces])


def _with_coarse_id(bins: DataFrame, factor: int, starts: Starts | None = None) -> DataFrame:
    """``bins`` with ``new_id``. The table occurs once in the plan, so that levels made from each other grow it by a step each instead of doubling it."""
    starts = sequence_starts(bins) if starts is None else starts
    pieces = _coarse_pieces(starts, factor)
    if 0 < len(pieces) <= MOST_PIECES:
        return bins.withColumn("new_id", _coarser("bin_id", pieces, factor))
    chroms = [c for _, c, _ in starts]
    offsets = small_table(bins.sparkSession, [(c, *p) for c, p in zip(chroms, pieces)], "chrom_id int, _old long, _new long")
    return bins.join(offsets, "chrom_id").withColumn("new_id", F.col("_new") + F.expr(f"(bin_id - _old) div {factor}"))


def coarse_id(bins: DataFrame, factor: int, starts: Starts | None = None) -> DataFrame:
    """(bin_id, new_id): each sequence's bins in groups of ``factor``."""
    return _with_coarse_id(bins, factor, starts).select("bin_id", "new_id")


def coarsen_bins(bins: DataFrame, factor: int, starts: Starts | None = None) -> DataFrame:
    """Bins of ``factor`` consecutive ones, the last of a sequence of what is left. ``starts`` are the bins' :func:`sequence_starts`, where known."""
    grouped = _with_coarse_id(bins, factor, starts).groupBy("new_id", "chrom_id", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return grouped.select(F.col("new_id").alias("bin_id"), "chrom_id", "chrom", "start", "end")


def coarsen_pixels(pixels: DataFrame, bins: DataFrame, factor: int, columns: Sequence[str] = ("count",), how: Mapping[str, object] | None = None, starts: Starts | None = None) -> DataFrame:
    """Pixels of the coarser bins, values aggregated (summed by default).

    The new ids follow from the old by arithmetic on the sequences' first bins, or by joins with the bin table if there are many sequences.
    """
    how = dict(how or {})
    starts = sequence_starts(bins) if starts is None else starts
    pieces, rows = _coarse_pieces(starts, factor), pixels.select(*PIXEL_KEYS, *columns)
    if 0 < len(pieces) <= MOST_PIECES:
        rows = rows.withColumns({f"_{k}": _coarser(k, pieces, factor) for k in PIXEL_KEYS})
    else:
        ids = coarse_id(bins, factor, starts)
        for k in PIXEL_KEYS:
            rows = rows.join(ids.select(F.col("bin_id").alias(k), F.col("new_id").alias(f"_{k}")), k)
    types = {f.name: f.dataType for f in rows.schema}
    rows = dealt(rows.select(*(F.col(f"_{k}").alias(k) for k in PIXEL_KEYS), *columns), *PIXEL_KEYS)
    return rows.groupBy(*PIXEL_KEYS).agg(*(aggregate(how.get(c, "sum"), c, types[c]).alias(c) for c in columns))


Level = tuple[DataFrame, DataFrame]


def zoomify(bases: Mapping[int, Level], targets: Sequence[int], columns: Sequence[str] = ("count",), how: Mapping[str, object] | None = None, keep=lambda resolution, level: level) -> dict[int, Level]:
    """(bins, pixels) of every base and target resolution, each target from its largest smaller divisor.

    ``keep`` may store a level and return it read back, so that later levels do not compute it again; by default levels stay lazy.
    """
    made: dict[int, Level] = {}
    for resolution, source, factor in predecessors(list(bases), targets):
        if source is None:
            made[resolution] = keep(resolution, bases[resolution])
        else:
            bins, pixels = made[source]
            made[resolution] = keep(resolution, (coarsen_bins(bins, factor), coarsen_pixels(pixels, bins, factor, columns, how)))
    return made


def zoom_levels(bins: DataFrame, pixels: DataFrame, columns: Sequence[str] = ("count",), keep=lambda level, tables: tables, tile: int = 256, how: Mapping[str, object] | None = None) -> dict[int, Level]:
    """The factor-2 pyramid: the base is the deepest level, level 0 fits one tile of ``tile`` bins."""
    size = binsize_of(bins)
    if size is None:
        raise ValueError("the pyramid needs fixed bins")
    depth = quad_tile_depth(chromsizes_of(bins).total, size, tile)
    out, starts = {depth: keep(depth, (bins, pixels))}, sequence_starts(bins)
    for level in range(depth - 1, -1, -1):
        bins, pixels = out[level + 1]
        out[level] = keep(level, (coarsen_bins(bins, 2, starts), coarsen_pixels(pixels, bins, 2, columns, how, starts)))
        starts = coarser_starts(starts, 2)
    return out
