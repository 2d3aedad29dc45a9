"""Queries on pixel tables: boxes, symmetric completion, annotation, balanced and dense values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import MOST_PIECES, piecewise, sequence_starts
from ..plans.genome import PIXEL_KEYS

Box = tuple[int, int, int, int]

#: Cells that a dense result may have.
DENSE_CELLS = 10**8
#: Cells that are drawn.
SHOWN_CELLS = 10**7
#: Weights of these names divide.
DIVISIVE = ("KR", "VC", "VC_SQRT")


def _inside(rows: str, cols: str, box: Box) -> Column:
    i0, i1, j0, j1 = box
    return (F.col(rows) >= i0) & (F.col(rows) < i1) & (F.col(cols) >= j0) & (F.col(cols) < j1)


def slice_rows(table: DataFrame, key: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Rows lo to hi of a numbered table."""
    out = table
    if lo is not None:
        out = out.where(F.col(key) >= lo)
    if hi is not None:
        out = out.where(F.col(key) < hi)
    return out


def box(pixels: DataFrame, bounds: Box) -> DataFrame:
    """Stored pixels of a box; the comparisons reach the Parquet scan."""
    return pixels.where(_inside(*PIXEL_KEYS, bounds))


def fill_lower(pixels: DataFrame, bounds: Box) -> DataFrame:
    """The box of the symmetric matrix whose upper triangle is stored: pixels in the box and mirror images that fall in it.

    One scan gives both: a pixel is kept once for itself and once for its image, as far as they lie in the box.
    """
    b1, b2 = PIXEL_KEYS
    i0, i1, j0, j1 = bounds
    upper = _inside(b1, b2, bounds)
    if i0 <= i1 <= j0:  # wholly above the diagonal: no image falls in it
        return pixels.where(upper)
    image = (F.col(b1) != F.col(b2)) & _inside(b2, b1, bounds)
    sides = F.filter(F.array(F.when(upper, F.lit(False)), F.when(image, F.lit(True))), lambda x: x.isNotNull())
    rows = pixels.where(upper | image).withColumn("_image", F.explode(sides))
    turned = {b1: b2, b2: b1}
    return rows.select(*(F.when(F.col("_image"), F.col(turned[c])).otherwise(F.col(c)).alias(c) if c in turned else F.col(c) for c in pixels.columns))


def cis(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """Pixels inside a sequence."""
    return _with_chroms(pixels, bins).where(F.col("_c1") == F.col("_c2")).drop("_c1", "_c2")


def trans(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """Pixels between sequences."""
    return _with_chroms(pixels, bins).where(F.col("_c1") != F.col("_c2")).drop("_c1", "_c2")


def _with_chroms(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """Pixels with the sequences' numbers ``_c1`` and ``_c2``: comparisons with their first bins, or joins if there are many."""
    starts = sequence_starts(bins)
    if 0 < len(starts) <= MOST_PIECES:
        pieces = [(first, F.lit(c)) for first, c, _ in starts]
        return pixels.withColumns({f"_c{k}": piecewise(F.col(f"bin{k}_id"), pieces) for k in "12"})
    for k in "12":
        pixels = pixels.join(bins.select(F.col("bin_id").alias(f"_b{k}"), F.col("chrom_id").alias(f"_c{k}")), F.col(f"bin{k}_id") == F.col(f"_b{k}")).drop(f"_b{k}")
    return pixels


def off_diagonal(pixels: DataFrame, n: int) -> DataFrame:
    """Pixels at least n bins from the diagonal."""
    return pixels.where(F.abs(F.col("bin1_id") - F.col("bin2_id")) >= n)


def annotate(pixels: DataFrame, bins: DataFrame, columns: Sequence[str] | None = None, replace: bool = False) -> DataFrame:
    """Bin columns to the left of the pixels', suffixed 1 and 2, for whichever of bin1_id and bin2_id there is; null where a bin is missing."""
    columns = [c for c in bins.columns if c not in ("bin_id", "chrom_id")] if columns is None else list(columns)
    out, front = pixels, []
    for k in ("1", "2"):
        if f"bin{k}_id" in pixels.columns:
            side = bins.select(F.col("bin_id").alias(f"_b{k}"), *(F.col(c).alias(f"{c}{k}") for c in columns))
            out = out.join(side, F.col(f"bin{k}_id") == F.col(f"_b{k}"), "left")
            front += [f"{c}{k}" for c in columns]
    keep = [c for c in pixels.columns if not (replace and c in PIXEL_KEYS)]
    return out.select(*front, *keep)


def balanced(pixels: DataFrame, bins: DataFrame, weight: str = "weight", divisive: bool | None = None, value: str = "count", out: str = "balanced") -> DataFrame:
    """Pixels with ``out`` = weight1 * weight2 * value; divisive weights are inverted first (by default those of the usual names). A masked
    bin's weight, NaN or null, gives NaN; a divisive weight of 0 counts as infinite."""
    if weight not in bins.columns:
        raise ValueError(f"no column {weight!r} in the bin table: balance the matrix first")
    divisive = weight in DIVISIVE if divisive is None else divisive
    w = F.coalesce(F.col(weight), F.lit(float("nan")))
    if divisive:
        w = F.when(w == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), w))
    weights = bins.select("bin_id", w.alias("_w"))
    rows = pixels
    for k in ("1", "2"):
        rows = rows.join(weights.select(F.col("bin_id").alias(f"_b{k}"), F.col("_w").alias(f"_w{k}")), F.col(f"bin{k}_id") == F.col(f"_b{k}"), "left").drop(f"_b{k}")
    return rows.withColumn(out, F.coalesce("_w1", F.lit(float("nan"))) * F.coalesce("_w2", F.lit(float("nan"))) * F.col(value)).drop("_w1", "_w2")


def dense(pixels: DataFrame, bins: DataFrame, bounds: Box, value: str = "count", weight: str | None = None, symmetric: bool = True, divisive: bool | None = None) -> DataFrame:
    """Every cell of a box as a row: missing pixels are 0, masked rows and columns NaN when balanced. Boxes over DENSE_CELLS are refused."""
    i0, i1, j0, j1 = bounds
    if (i1 - i0) * (j1 - j0) > DENSE_CELLS:
        raise ValueError("the box has too many cells for a dense result")
    spark = pixels.sparkSession
    rows = spark.range(i0, i1).select(F.col("id").alias("bin1_id"))
    cells = rows.select("bin1_id", F.explode(F.sequence(F.lit(j0).cast("long"), F.lit(j1 - 1).cast("long"))).alias("bin2_id")) if j1 > j0 else rows.select("bin1_id", F.lit(0).cast("long").alias("bin2_id")).limit(0)
    stored = (fill_lower if symmetric else box)(pixels, bounds).groupBy(*PIXEL_KEYS).agg(F.sum(value).alias(value))
    full = cells.join(stored, list(PIXEL_KEYS), "left").select(*PIXEL_KEYS, F.coalesce(value, F.lit(0)).alias(value))
    return balanced(full, bins, weight, divisive, value, value) if weight else full


def to_arrays(pixels: DataFrame, bounds: Box, value: str = "count"):
    """(row, column, value) numpy arrays of a box's pixels, relative to the box; gathered on the driver, so boxes over DENSE_CELLS are refused."""
    i0, i1, j0, j1 = bounds
    if (i1 - i0) * (j1 - j0) > DENSE_CELLS:
        raise ValueError("the box has too many cells to be gathered")
    found = pixels.select(*PIXEL_KEYS, value).toPandas()
    return found["bin1_id"].to_numpy() - i0, found["bin2_id"].to_numpy() - j0, found[value].to_numpy()


def to_matrix(pixels: DataFrame, bounds: Box, value: str = "count"):
    """A box's pixels as a dense numpy array; repeated pixels add up."""
    import numpy as np

    r, c, v = to_arrays(pixels, bounds, value)
    out = np.zeros((bounds[1] - bounds[0], bounds[3] - bounds[2]), dtype=v.dtype if len(v) else float)
    np.add.at(out, (r, c), v)
    return out


def distance_decay(pixels: DataFrame, bins: DataFrame, value: str = "count") -> DataFrame:
    """Sum and number of cis pixels at each distance in bins."""
    return cis(pixels, bins).groupBy((F.col("bin2_id") - F.col("bin1_id")).alias("distance")).agg(F.sum(value).alias(value), F.count("*").alias("n_pixels"))


def scaled(pixels: DataFrame, value: str = "count", scale: str = "linear") -> DataFrame:
    """Values as they are, or their logarithms; null where there is none."""
    forms = {"linear": F.col(value), "log2": F.log2(F.when(F.col(value) > 0, F.col(value))), "log10": F.log10(F.when(F.col(value) > 0, F.col(value)))}
    return pixels.withColumn(value, forms[scale])


def one_based(rows: DataFrame, ids: bool = False, starts: bool = False) -> DataFrame:
    """Bin ids and starts counted from 1."""
    shift = [c for c in rows.columns if (ids and c in ("bin_id", *PIXEL_KEYS)) or (starts and c in ("start", "start1", "start2"))]
    return rows.withColumns({c: F.col(c) + 1 for c in shift})
