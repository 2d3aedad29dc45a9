"""Matrix balancing by iterative correction.

The pixels stay distributed. Each iteration is one job that sums every bin's products of value and both biases; the
biases, a number a bin, live on the driver and are broadcast while there are at most ``BROADCAST_BINS`` of them. Beyond that
:func:`balance_large` keeps the bias as a table, joined to both sides of the pixels, and the driver sees two numbers a sequence in an iteration.
In cis all sequences are corrected in the same jobs, each until it has converged itself.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import median_and_mad, overlapping, sequence_starts
from ..plans.genome import PIXEL_KEYS, small_table
from ..sources.scratch import checkpointed, dropped
from .query import cis, off_diagonal, trans

#: 8 bytes each: 32 MB at most are broadcast, and 64 MB gathered in an iteration.
BROADCAST_BINS = 4_000_000


class ConvergenceWarning(UserWarning):
    """The variance of the marginals did not fall below the tolerance."""


def marginals(pixels: DataFrame, value: str = "count") -> DataFrame:
    """(bin_id, total, nnz): sums and numbers of nonzero pixels over both ends; a diagonal pixel counts twice."""
    ends = pixels.select(F.explode(F.array(*PIXEL_KEYS)).alias("bin_id"), F.col(value).alias("v"))
    return ends.groupBy("bin_id").agg(F.sum("v").alias("total"), F.sum(F.when(F.col("v") != 0, 1).otherwise(0)).alias("nnz"))


@dataclass
class Balance:
    """Weights by bin id (NaN: masked), and how they came about."""

    weights: np.ndarray
    stats: dict = field(default_factory=dict)

    def table(self, spark) -> DataFrame:
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame({"bin_id": np.arange(len(self.weights)), "weight": self.weights}), "bin_id long, weight double")


#: Pixels are added to a vector of all bins so many at once, or as many as there are bins.
_LEAST_ADDED = 1 << 16


def _added(batches: Iterator[pa.RecordBatch], n: int, factor: np.ndarray | None, value: str) -> np.ndarray:
    """Marginals of all batches. A step over all bins is taken once for as many pixels, not for every batch: both numbers grow with the input."""
    total, held, rows = np.zeros(n), [], 0

    def fold() -> None:
        a, b, v = (np.concatenate(x) for x in zip(*held))
        if factor is not None:
            v = v * factor[a] * factor[b]
        np.add(total, np.bincount(a, v, n), out=total)
        np.add(total, np.bincount(b, v, n), out=total)

    for batch in batches:
        held.append((*(batch.column(k).to_numpy() for k in PIXEL_KEYS), batch.column(value).to_numpy().astype(np.float64)))
        rows += batch.num_rows
        if rows >= max(n, _LEAST_ADDED):
            fold()
            held, rows = [], 0
    if held:
        fold()
    return total


def _sums(pixels: DataFrame, n: int, factor: np.ndarray | None, value: str = "_v") -> np.ndarray:
    """Marginals of value * factor[bin1] * factor[bin2], one vector a task, added by bin. There are as many tasks as cores, whatever the pixels'
    partitions, as every task sends a row for each bin it met."""
    spark = pixels.sparkSession
    shared = None if factor is None else spark.sparkContext.broadcast(factor)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _added(batches, n, None if shared is None else shared.value, value)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bin_id", "s"])

    found = pixels.select(*PIXEL_KEYS, value).coalesce(spark.sparkContext.defaultParallelism).mapInArrow(partial, "bin_id long, s double").groupBy("bin_id").agg(F.sum("s").alias("s")).toPandas()  # a row a bin
    out = np.zeros(n)
    out[found["bin_id"].to_numpy(dtype=np.int64)] = found["s"]
    if shared is not None:
        shared.unpersist()
    return out


def _median(x: np.ndarray) -> float:
    return float(np.median(x)) if len(x) else float("nan")


def mad_mask(marg: np.ndarray, chrom_of: np.ndarray, mad_max: float) -> np.ndarray:
    """Bins whose marginal, relative to its sequence's median, is too far below the others' on a log scale."""
    relative = marg.astype(float).copy()
    for c in np.unique(chrom_of):
        own = chrom_of == c
        relative[own] /= _median(marg[own & (marg > 0)])
    logs = np.log(relative[relative > 0])
    middle = _median(logs)
    cutoff = np.exp(middle - mad_max * _median(np.abs(logs - middle)))
    with np.errstate(invalid="ignore"):
        return relative < cutoff


def _iterate(pixels: DataFrame, bias: np.ndarray, group: np.ndarray, weight: np.ndarray | None, tol: float, max_iters: int, rescale: bool) -> tuple[np.ndarray, np.ndarray]:
    """Correct ``bias`` in place, every group of bins until its own marginals' variance is below the tolerance; the scales and last variances by group."""
    n, groups = len(bias), int(group.max(initial=-1)) + 1
    scale, var, going = np.full(groups, np.nan), np.zeros(groups), np.ones(groups, dtype=bool)
    for _ in range(max_iters):
        factor = np.nan_to_num(bias if weight is None else bias * weight)
        marg = _sums(pixels, n, factor)
        some = marg != 0
        count = np.bincount(group[some], minlength=groups)
        empty = going & (count == 0)
        bias[empty[group]] = np.nan
        scale[empty], var[empty] = np.nan, 0.0
        going &= count > 0
        mean = np.bincount(group[some], marg[some], groups) / np.maximum(count, 1)
        spread = np.bincount(group[some], (marg[some] - mean[group[some]]) ** 2, groups) / np.maximum(count, 1)
        scale[going], var[going] = mean[going], spread[going]
        own = going[group] & some
        bias[own] /= marg[own] / mean[group[own]]
        going &= var >= tol
        if not going.any():
            break
    else:
        warnings.warn("balancing did not converge", ConvergenceWarning, stacklevel=3)
    bias[bias == 0] = np.nan
    if rescale:
        bias /= np.sqrt(scale)[group]
    return scale, var


def balance(
    pixels: DataFrame,
    bins: DataFrame,
    *,
    cis_only: bool = False,
    trans_only: bool = False,
    ignore_diags: int = 2,
    mad_max: float = 5,
    min_nnz: int = 10,
    min_count: float = 0,
    blacklist: DataFrame | None = None,
    rescale: bool = True,
    x0: Sequence[float] | None = None,
    tol: float = 1e-5,
    max_iters: int = 200,
    value: str = "count",
) -> Balance:
    """Weights that make all bins' marginals equal: genome-wide, inside each sequence (``cis_only``), or between them (``trans_only``).

    Before that, bins are masked that have fewer than ``min_nnz`` nonzero pixels, a marginal below ``min_count``, one more
    than ``mad_max`` median deviations below the median, or an overlap with ``blacklist`` (chrom, start, end).
    """
    if cis_only and trans_only:
        raise ValueError("cis_only and trans_only exclude each other")
    if bins.count() > BROADCAST_BINS:
        raise ValueError(f"over {BROADCAST_BINS} bins: use balance_large")
    axis = bins.select("bin_id", "chrom_id").orderBy("bin_id").toPandas()  # a row a bin
    n, chrom_of = len(axis), axis["chrom_id"].to_numpy()
    edges = np.flatnonzero(np.diff(chrom_of)) + 1
    bounds = list(zip([0, *edges], [*edges, n]))
    rows = off_diagonal(pixels, ignore_diags) if ignore_diags else pixels
    if cis_only:
        rows = cis(rows, bins)
    rows = rows.select(*PIXEL_KEYS, F.col(value).cast("double").alias("_v")).persist()
    try:
        rows.count()  # fills the cache by the pixels' own tasks, before fewer read it
        bias = np.ones(n) if x0 is None else np.nan_to_num(np.array(x0, dtype=float), nan=0.0)
        if min_nnz > 0:
            bias[_sums(rows.withColumn("_v", (F.col("_v") != 0).cast("double")), n, None) < min_nnz] = 0
        if min_count or mad_max > 0:
            marg = _sums(rows, n, None)
            if min_count:
                bias[marg < min_count] = 0
            if mad_max > 0:
                bias[mad_mask(marg, chrom_of, mad_max)] = 0
        if blacklist is not None:
            bad = [r["bin_id"] for r in overlapping(bins, blacklist).select("bin_id").collect()]
            bias[bad] = 0
        weight, between, group = None, rows, np.zeros(n, dtype=np.int64)
        if cis_only:
            group = np.repeat(np.arange(len(bounds)), [hi - lo for lo, hi in bounds])
        elif trans_only:
            share = np.array([hi - lo for lo, hi in bounds]) / n
            weight = np.repeat(1 / (1 - share), [hi - lo for lo, hi in bounds]) if len(bounds) > 1 else np.ones(n)
            between = trans(rows, bins).select(*PIXEL_KEYS, "_v")
        scale, var = _iterate(between, bias, group, weight, tol, max_iters, rescale)
        converged = bool((var < tol).all())
        if not cis_only:
            scale, var = (float(scale[0]), float(var[0])) if n else (float("nan"), 0.0)
    finally:
        rows.unpersist()
    stats = {"tol": tol, "min_nnz": min_nnz, "min_count": min_count, "mad_max": mad_max, "cis_only": cis_only, "ignore_diags": ignore_diags, "scale": scale, "converged": converged, "var": var, "divisive_weights": False}
    return Balance(bias, stats)


def balance_large(
    pixels: DataFrame,
    bins: DataFrame,
    store: Callable[[DataFrame], DataFrame] = checkpointed,
    *,
    cis_only: bool = False,
    trans_only: bool = False,
    ignore_diags: int = 2,
    mad_max: float = 5,
    min_nnz: int = 10,
    min_count: float = 0,
    blacklist: DataFrame | None = None,
    rescale: bool = True,
    x0: DataFrame | None = None,
    tol: float = 1e-5,
    max_iters: int = 200,
    value: str = "count",
) -> tuple[DataFrame, dict]:
    """:func:`balance` wholly as joins and aggregates, for bins too many to broadcast: (bin_id, weight), and how it came about.

    ``store(df)`` saves a table and returns it read back, to cut the lineage; ``x0`` is a table (bin_id, weight). The driver sees a row a sequence.
    """
    if cis_only and trans_only:
        raise ValueError("cis_only and trans_only exclude each other")
    rows = off_diagonal(pixels, ignore_diags) if ignore_diags else pixels
    if cis_only:
        rows = cis(rows, bins)
    rows = store(rows.select(*PIXEL_KEYS, F.col(value).cast("double").alias("v")))
    starts = sequence_starts(bins)
    total = sum(n for *_, n in starts)
    share = F.lit(1.0)
    if trans_only and len(starts) > 1:
        shares = bins.groupBy("chrom_id").agg((1 / (1 - F.count("*") / F.lit(total))).alias("cw"))
        spread, share = bins.join(shares, "chrom_id"), F.col("cw")
    else:
        spread = bins
    now = spread.select("bin_id", "chrom_id", (F.col("chrom_id") if cis_only else F.lit(0)).alias("g"), share.alias("cw"), F.lit(1.0).alias("bias"))
    if x0 is not None:
        given = x0.select("bin_id", F.coalesce(F.nanvl("weight", F.lit(0.0)), F.lit(0.0)).alias("_x"))
        now = now.join(given, "bin_id", "left").withColumn("bias", F.coalesce("_x", F.lit(0.0))).drop("_x")
    now = store(_masked(now, rows, bins, mad_max, min_nnz, min_count, blacklist))
    between = store(trans(rows, bins).select(*PIXEL_KEYS, "v")) if trans_only else rows
    scale: dict[int, float] = {}
    var: dict[int, float] = {}
    going = {c for _, c, _ in starts} if cis_only else {0} if starts else set()
    for _ in range(max_iters):
        w = now.select("bin_id", (F.col("bias") * F.col("cw")).alias("w"))
        product = between.join(w.select(F.col("bin_id").alias("bin1_id"), F.col("w").alias("w1")), "bin1_id").join(w.select(F.col("bin_id").alias("bin2_id"), F.col("w").alias("w2")), "bin2_id")
        ends = product.select(F.explode(F.array(*PIXEL_KEYS)).alias("bin_id"), (F.col("v") * F.col("w1") * F.col("w2")).alias("m"))
        marg = store(now.join(ends.groupBy("bin_id").agg(F.sum("m").alias("m")), "bin_id", "left").withColumn("m", F.coalesce("m", F.lit(0.0))))
        found = {r["g"]: r for r in marg.where("m <> 0").groupBy("g").agg(F.avg("m").alias("mu"), F.var_pop("m").alias("var")).collect()}  # a row a sequence
        for g in going:
            scale[g], var[g] = (found[g]["mu"], found[g]["var"]) if g in found else (float("nan"), 0.0)
        means = small_table(bins.sparkSession, [(g, scale[g]) for g in sorted(going)], "g int, _mu double")
        step = F.when(F.col("_mu").isNull() | (F.col("m") == 0) & ~F.isnan("_mu"), 1.0).when(F.isnan("_mu"), F.lit(float("inf"))).otherwise(F.col("m") / F.col("_mu"))
        before, now = now, store(marg.join(means, "g", "left").select("bin_id", "chrom_id", "g", "cw", (F.col("bias") / step).alias("bias")))
        dropped(before)
        dropped(marg)
        going = {g for g in going if var[g] >= tol}
        if not going:
            break
    else:
        warnings.warn("balancing did not converge", ConvergenceWarning, stacklevel=2)
    scales = small_table(bins.sparkSession, [(g, scale[g] ** 0.5 if rescale else 1.0) for g in sorted(scale)], "g int, _s double")
    weight = F.when(F.col("bias") == 0, float("nan")).otherwise(F.col("bias") / F.coalesce("_s", F.lit(1.0)))
    ordered = [scale[g] for g in sorted(scale)], [var[g] for g in sorted(var)]
    stats = {"scale": ordered[0] if cis_only else next(iter(ordered[0]), float("nan")), "var": ordered[1] if cis_only else next(iter(ordered[1]), 0.0), "converged": all(v < tol for v in var.values())}
    return now.join(scales, "g", "left").select("bin_id", weight.alias("weight")), stats


def _masked(now: DataFrame, rows: DataFrame, bins: DataFrame, mad_max: float, min_nnz: int, min_count: float, blacklist: DataFrame | None) -> DataFrame:
    """``now`` with the bias of bins that a filter refuses set to 0."""
    bad = F.lit(False)
    if min_nnz > 0 or min_count or mad_max > 0:
        sums = marginals(rows, "v").select("bin_id", "total", "nnz")
        now = now.join(sums, "bin_id", "left").withColumns({"total": F.coalesce("total", F.lit(0.0)), "nnz": F.coalesce("nnz", F.lit(0))})
        if min_nnz > 0:
            bad = bad | (F.col("nnz") < min_nnz)
        if min_count:
            bad = bad | (F.col("total") < min_count)
        if mad_max > 0:
            middles = now.where("total > 0").groupBy("chrom_id").agg(F.median("total").alias("_md"))
            now = checkpointed(now.join(middles, "chrom_id", "left").withColumn("_r", F.col("total") / F.col("_md")).drop("_md"))  # a row a bin, used twice more
            center, spread = median_and_mad(now.where("_r > 0").select(F.log("_r").alias("l")), "l")
            bad = bad | (F.col("_r") < float(np.exp(center - mad_max * spread)))
    if blacklist is not None:
        struck = overlapping(bins, blacklist).select("bin_id", F.lit(True).alias("_struck"))
        now, bad = now.join(struck, "bin_id", "left"), bad | F.col("_struck").isNotNull()
    return now.select("bin_id", "chrom_id", "g", "cw", F.when(F.coalesce(bad, F.lit(False)), 0.0).otherwise(F.col("bias")).alias("bias"))
