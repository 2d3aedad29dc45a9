"""From point pairs and pixel triples to a pixel table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.genome import PIXEL_KEYS, Genome, small_table
from ..sources.tasks import dealt

#: Spark's form of the usual names of aggregate functions. NaN counts as missing, as does null.
_AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "median": F.median,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "count": F.count,
    "size": lambda c: F.count(F.lit(1)),
    "nunique": F.count_distinct,
    "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
}


class InvalidPairs(ValueError):
    """Records or pixels that a check refuses."""


def aggregate(how, column: str, dtype: T.DataType, order: Sequence[str] = ()) -> Column:
    """An aggregate by name or function. ``first`` and ``last`` follow ``order``; a function must be a grouped-aggregate pandas UDF or take a Column."""
    c = F.col(column)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    if callable(how):
        return how(c)
    if how in ("first", "last"):
        if not order:
            raise ValueError(f"{how} needs an order")
        pick = F.min_by if how == "first" else F.max_by
        key = F.when(c.isNotNull(), F.struct(*order))
        return pick(c, key)
    if how not in _AGGREGATES:
        raise ValueError(f"unknown aggregate: {how}")
    return _AGGREGATES[how](c)


def swap_where(rows: DataFrame, where: Column, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Exchange each pair of columns in the rows that meet the condition."""
    changed = {}
    for a, b in pairs:
        changed[a] = F.when(where, F.col(b)).otherwise(F.col(a))
        changed[b] = F.when(where, F.col(a)).otherwise(F.col(b))
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns))


def _no_rows(rows: DataFrame, bad: Column, what: str) -> None:
    found = rows.where(bad).limit(5).collect()
    if found:
        raise InvalidPairs(f"{what}, for example {[r.asDict() for r in found]}")


def _checked(rows: DataFrame, bad: Column, what: str, eager: bool, column: str) -> DataFrame:
    """Refuse bad rows now, or when they are computed: with ``column``, which the results must depend on, or the check would be pruned."""
    if eager:
        _no_rows(rows, bad, what)
        return rows
    kind = rows.schema[column].dataType
    return rows.withColumn(column, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(what)).cast(kind)).otherwise(F.col(column)))


def assign_variable(rows: DataFrame, bins: DataFrame, chrom_id: str, pos: str, out: str, width: int | None = None) -> DataFrame:
    """``out``: the bin of a position among bins of any widths; positions in no bin are dropped.

    Bins are listed under every stretch of ``width`` positions they touch (by default the mean bin width), so that an equality
    join on (sequence, stretch) leaves a few bins a position to compare, however many there are.
    """
    if width is None:
        width = max(1, int(bins.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 1))
    stretch = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    listed = bins.where(F.col("end") > F.col("start")).select(F.col("chrom_id").alias("_ci"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("bin_id").alias(out), stretch.alias("_st"))
    near = rows.withColumn("_at", F.floor(F.col(pos) / width))
    met = near.join(listed, (near[chrom_id] == listed["_ci"]) & (near["_at"] == listed["_st"]) & (near[pos] >= listed["_s"]) & (near[pos] < listed["_e"]))
    return met.drop("_ci", "_s", "_e", "_st", "_at")


def sanitize_records(
    records: DataFrame,
    genome: Genome,
    *,
    binsize: int | None = None,
    bins: DataFrame | None = None,
    chrom: str = "chrom",
    anchor: str = "pos",
    suffixes: tuple[str, str] = ("1", "2"),
    sided: Sequence[str] = (),
    decode_chroms: bool = True,
    one_based: bool = False,
    triangle: str | None = "reflect",
    validate: bool = True,
    strict: bool = True,
    eager: bool = False,
) -> DataFrame:
    """Records with bin1_id and bin2_id.

    In order: names become ids of the genome's enumeration and records with an unknown (or, if ids are given, a negative) one
    are dropped; one-based positions are shifted; negative and overlong positions are refused (``strict`` refuses the length itself, too);
    the lower triangle, by (sequence, position), is reflected with all ``sided`` fields, dropped, refused (``raise``) or let be (None);
    bins are found by arithmetic (``binsize``) or in ``bins``.
    """
    spark = records.sparkSession
    s1, s2 = suffixes
    c1, c2, a1, a2 = chrom + s1, chrom + s2, anchor + s1, anchor + s2
    rows = records
    first = genome.fixed_offsets(binsize) if binsize else [0] * len(genome.sizes)
    known = small_table(spark, [(n, i, x, first[i]) for i, (n, x) in enumerate(genome.sizes)], "_name string, _id int, _len long, _first long")
    for c, side in ((c1, "1"), (c2, "2")):
        k = known.select(F.col("_name").alias(f"_name{side}"), F.col("_id").alias(f"_id{side}"), F.col("_len").alias(f"_len{side}"), F.col("_first").alias(f"_first{side}"))
        rows = rows.join(k, rows[c] == (k[f"_name{side}"] if decode_chroms else k[f"_id{side}"])).drop(f"_name{side}")
    if one_based:
        rows = rows.withColumns({a: F.col(a) - 1 for a in (a1, a2)})
    if validate:
        for a, side in ((a1, "1"), (a2, "2")):
            over = F.col(a) >= F.col(f"_len{side}") if strict else F.col(a) > F.col(f"_len{side}")
            rows = _checked(rows, (F.col(a) < 0) | over, f"{a} lies outside its sequence", eager, a)
    lower = (F.col("_id1") > F.col("_id2")) | ((F.col("_id1") == F.col("_id2")) & (F.col(a1) > F.col(a2)))
    if triangle == "reflect":
        both = [(c1, c2), (a1, a2), ("_id1", "_id2"), ("_len1", "_len2"), ("_first1", "_first2"), *((f + s1, f + s2) for f in sided)]
        rows = swap_where(rows, lower, both)
    elif triangle == "drop":
        rows = rows.where(~lower)
    elif triangle == "raise":
        rows = _checked(rows, lower, "a record lies in the lower triangle", eager, a1)
    elif triangle is not None:
        raise ValueError(f"unknown triangle action: {triangle}")
    for a, side in ((a1, "1"), (a2, "2")):
        if binsize:
            rows = rows.withColumn(f"bin{side}_id", F.col(f"_first{side}") + F.expr(f"cast(`{a}` as bigint) div {binsize}"))
        else:
            rows = assign_variable(rows, bins, f"_id{side}", a, f"bin{side}_id")
    return rows.drop("_id1", "_id2", "_len1", "_len2", "_first1", "_first2")


def sanitize_pixels(pixels: DataFrame, *, one_based: bool = False, triangle: str | None = "reflect", sided: Sequence[str] = (), suffixes: tuple[str, str] = ("1", "2"), eager: bool = False) -> DataFrame:
    """Pixels with zero-based ids and the lower triangle reflected (with ``sided`` fields), dropped, refused or let be."""
    b1, b2 = PIXEL_KEYS
    rows = pixels.withColumns({b: F.col(b) - 1 for b in PIXEL_KEYS}) if one_based else pixels
    lower = F.col(b1) > F.col(b2)
    if triangle == "reflect":
        return swap_where(rows, lower, [(b1, b2), *((f + suffixes[0], f + suffixes[1]) for f in sided)])
    if triangle == "drop":
        return rows.where(~lower)
    if triangle == "raise":
        return _checked(rows, lower, "a pixel lies in the lower triangle", eager, b1)
    if triangle is not None:
        raise ValueError(f"unknown triangle action: {triangle}")
    return rows


def misplaced(n_bins: int, bounds: bool = True, upper: bool = True) -> Column:
    """Whether a pixel's ids lie outside the bins, or below the diagonal."""
    b1, b2 = (F.col(c) for c in PIXEL_KEYS)
    bad = F.lit(False)
    if bounds:
        bad = bad | (b1 < 0) | (b2 < 0) | (b1 >= n_bins) | (b2 >= n_bins) | b1.isNull() | b2.isNull()
    return bad | (b1 > b2) if upper else bad


def validate_pixels(pixels: DataFrame, n_bins: int, *, bounds: bool = True, upper: bool = True, duplicates: bool = True) -> DataFrame:
    """The pixels, or InvalidPairs: ids outside the bins, below the diagonal, or repeated anywhere."""
    if bounds or upper:
        _no_rows(pixels, misplaced(n_bins, bounds, upper), "pixels out of bounds or below the diagonal")
    if duplicates:
        _no_rows(duplicate_pixels(pixels), F.lit(True), "pixels occur more than once")
    return pixels


def duplicate_pixels(pixels: DataFrame) -> DataFrame:
    """(bin1_id, bin2_id, n) of pixels that occur more than once."""
    return dealt(pixels.select(*PIXEL_KEYS), *PIXEL_KEYS).groupBy(*PIXEL_KEYS).agg(F.count("*").alias("n")).where(F.col("n") > 1)


#: Rising runs that a task tells of; a sorted table has one for each file or piece of it.
_MOST_RUNS = 10_000


def _rising_runs(batches):
    """(first pixel, last pixel, whether one is repeated) of every stretch of rising pixels in a piece of a file; nulls and a table in no order give a last
    row of nulls."""
    import numpy as np
    import pyarrow as pa

    ends, n, begun, last, again = [], 0, None, None, False
    clear = True
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if any(batch.column(k).null_count for k in PIXEL_KEYS) or n > _MOST_RUNS:
            clear = False
            break
        a, b, piece = (batch.column(k).to_numpy() for k in (*PIXEL_KEYS, "_piece"))
        if last is None:
            begun = (int(a[0]), int(b[0]))
        else:
            a, b, piece = (np.concatenate([[x], y]) for x, y in zip(last, (a, b, piece)))
        level = a[1:] == a[:-1]
        falls = np.flatnonzero((a[1:] < a[:-1]) | (level & (b[1:] < b[:-1])) | (piece[1:] != piece[:-1]))
        same = np.flatnonzero(level & (b[1:] == b[:-1]))
        again |= len(same) > 0
        for i in falls[: _MOST_RUNS + 1]:
            ends.append((*begun, int(a[i]), int(b[i])))
            begun = (int(a[i + 1]), int(b[i + 1]))
        n, last = n + len(falls), (int(a[-1]), int(b[-1]), int(piece[-1]))
    if last is not None:
        ends.append((*begun, *last[:2]))
    columns = [pa.array([e[i] for e in ends] + ([] if clear else [None]), pa.int64()) for i in range(4)]
    yield pa.RecordBatch.from_arrays([*columns, pa.array([again] * len(columns[0]), pa.bool_())], names=["a0", "b0", "a1", "b1", "again"])


def strictly_rising(pixels: DataFrame) -> bool:
    """Whether a stored table's files are sorted by the pixels, lie in ranges of their own, and repeat no pixel: one pass in a few MB a task, without a
    shuffle. Files need not be read in order: the driver compares the ends of stretches, a row a file or piece of one."""
    piece = F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("_piece")
    runs = [tuple(r) for r in pixels.select(*(F.col(k).cast("long").alias(k) for k in PIXEL_KEYS), piece).mapInArrow(_rising_runs, "a0 long, b0 long, a1 long, b1 long, again boolean").collect()]
    if any(again or a0 is None for a0, *_, again in runs):
        return False
    runs.sort()
    return all(low[2:4] < high[0:2] for low, high in zip(runs, runs[1:]))


def _with_middles(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Records with ``_mid_c`` for each column c: its value in the one or two records that lie in the middle of their pixel, null in all others.

    A median by places needs a sort of plain rows; as an aggregate it would keep a map of values for every pixel.
    """
    for c in columns:
        value = F.col(c).cast("double")
        order = Window.partitionBy(*PIXEL_KEYS).orderBy(F.when(~F.isnan(value), value).asc_nulls_last())
        n = F.count(F.when(~F.isnan(value), value)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        placed = records.withColumns({"_place": F.row_number().over(order), "_n": n})
        middle = F.col("_place").isin(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)
        records = placed.withColumn(f"_mid_{c}", F.when(middle & ~F.isnan(value), value)).drop("_place", "_n")
    return records


def aggregate_records(records: DataFrame, how: Mapping[str, object] | None = None, *, count: bool = True, rename: Mapping[str, str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """One pixel a pair of bins: the number of records, unless ``how`` has its own ``count``, and an aggregate of each column of ``how``."""
    how, rename = dict(how or {}), dict(rename or {})
    types = {f.name: f.dataType for f in records.schema}
    middles = [c for c, h in how.items() if h == "median" and isinstance(types[c], T.NumericType)] if not records.isStreaming else []
    exact = {c: 0.5 * F.min(f"_mid_{c}") + 0.5 * F.max(f"_mid_{c}") for c in middles}
    out = [(exact[c] if c in exact else aggregate(h, c, types[c], order)).alias(rename.get(c, c)) for c, h in how.items()]
    if count and "count" not in {rename.get(c, c) for c in how}:
        out.insert(0, F.count(F.lit(1)).alias("count"))
    return _with_middles(dealt(records, *PIXEL_KEYS), middles).groupBy(*PIXEL_KEYS).agg(*out)


def pixels_from_pairs(records: DataFrame, genome: Genome, how: Mapping[str, object] | None = None, **options) -> DataFrame:
    """Sanitised and aggregated in one: one shuffle, partial sums first."""
    return aggregate_records(sanitize_records(records, genome, **options), how)


def pixels_from_bg2(bg2: DataFrame, genome: Genome, **options) -> DataFrame:
    """Pixels of rows (chrom1, start1, end1, chrom2, start2, end2, values): bins are found by the starts."""
    rows = sanitize_records(bg2, genome, anchor="start", sided=options.pop("sided", ("end",)), **options)
    return rows.drop("chrom1", "start1", "end1", "chrom2", "start2", "end2")


def pixels_from_array(rows: DataFrame, upper: bool = True) -> DataFrame:
    """Nonzero entries of a dense matrix given as (row_id, values)."""
    cells = rows.select(F.col("row_id").cast("long").alias("bin1_id"), F.posexplode("values").alias("bin2_id", "count")).withColumn("bin2_id", F.col("bin2_id").cast("long"))
    return cells.where((F.col("count") != 0) & (F.col("bin2_id") >= F.col("bin1_id") if upper else F.lit(True)))


def pixels_from_blocks(blocks: Mapping[tuple[str, str], DataFrame], offsets: Mapping[str, int]) -> DataFrame:
    """Upper-triangle pixels of per-sequence-pair blocks (row, col, count); a block below the diagonal is turned over."""
    parts = []
    for (a, b), block in blocks.items():
        cells = block.select((F.col("row") + offsets[a]).cast("long").alias("bin1_id"), (F.col("col") + offsets[b]).cast("long").alias("bin2_id"), "count")
        if a == b:
            parts.append(cells.where(F.col("bin1_id") <= F.col("bin2_id")))
        elif (offsets[b], b) > (offsets[a], a) or (b, a) not in blocks:
            parts.append(sanitize_pixels(cells))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("count") != 0)


def pixels_from_any(spark: SparkSession, data) -> DataFrame:
    """A Spark or pandas frame, a dict of equally long columns, or an iterable of these, as one table."""
    import pandas as pd

    if isinstance(data, DataFrame):
        return data
    if isinstance(data, (pd.DataFrame, Mapping)):
        return spark.createDataFrame(pd.DataFrame(data))
    parts = [pixels_from_any(spark, d) for d in data]
    if not parts:
        raise ValueError("no pixels given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pair_blocks(records: DataFrame) -> DataFrame:
    """(chrom1, chrom2, n): how many records each ordered pair of sequences has."""
    return records.groupBy("chrom1", "chrom2").agg(F.count("*").alias("n"))


def one_orientation(records: DataFrame) -> DataFrame:
    """The records, or InvalidPairs if two sequences occur in both orders. A row for each pair of sequences is compared, not the records."""
    blocks = pair_blocks(records).where(F.col("chrom1") != F.col("chrom2"))
    turned = blocks.select(F.col("chrom2").alias("chrom1"), F.col("chrom1").alias("chrom2"))
    _no_rows(blocks.join(turned, ["chrom1", "chrom2"], "left_semi"), F.lit(True), "two sequences occur in both orders")
    return records


def sort_pairs(records: DataFrame, genome: Genome, *, by: str = "blocks", flip_only: bool = False, sided: Sequence[str] = ()) -> DataFrame:
    """Records of known sequences with mates in upper-triangular order of the enumeration, sorted by names as text:
    ``blocks``: chrom1, chrom2, pos1, pos2; ``positions``: chrom1, pos1, chrom2, pos2."""
    ids = small_table(records.sparkSession, list(genome.ids.items()), "_n string, _i int")
    rows = records.join(ids.select(F.col("_n").alias("_n1"), F.col("_i").alias("_i1")), F.col("chrom1") == F.col("_n1")).join(ids.select(F.col("_n").alias("_n2"), F.col("_i").alias("_i2")), F.col("chrom2") == F.col("_n2"))
    lower = (F.col("_i1") > F.col("_i2")) | ((F.col("_i1") == F.col("_i2")) & (F.col("pos1") > F.col("pos2")))
    rows = swap_where(rows, lower, [("chrom1", "chrom2"), ("pos1", "pos2"), *((f + "1", f + "2") for f in sided)]).drop("_n1", "_n2", "_i1", "_i2")
    if flip_only:
        return rows
    return rows.orderBy(*(("chrom1", "chrom2", "pos1", "pos2") if by == "blocks" else ("chrom1", "pos1", "chrom2", "pos2")))
