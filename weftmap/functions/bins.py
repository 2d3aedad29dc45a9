"""Bin tables: making them, measuring them, and the offsets that follow from them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.genome import BINS, Genome, small_table
from ..sources.scratch import checkpointed

#: Recognition sites (IUPAC codes) and the cut's place in them.
ENZYMES = {
    "AluI": ("AGCT", 2), "BamHI": ("GGATCC", 1), "BglII": ("AGATCT", 1), "BspHI": ("TCATGA", 1), "Csp6I": ("GTAC", 1), "CviQI": ("GTAC", 1), "DdeI": ("CTNAG", 1), "DpnII": ("GATC", 0), "EcoRI": ("GAATTC", 1),
    "EcoRV": ("GATATC", 3), "HaeIII": ("GGCC", 2), "HindIII": ("AAGCTT", 1), "HinfI": ("GANTC", 1), "KpnI": ("GGTACC", 5), "MboI": ("GATC", 0), "MseI": ("TTAA", 1), "NcoI": ("CCATGG", 1), "NlaIII": ("CATG", 4),
    "NotI": ("GCGGCCGC", 2), "PstI": ("CTGCAG", 5), "Sau3AI": ("GATC", 0), "TaqI": ("TCGA", 1), "XbaI": ("TCTAGA", 1), "XhoI": ("CTCGAG", 1),
}
#: Sequences up to this number are told from bin ids by comparisons in the plan, more by a join with the bin table.
MOST_PIECES = 128
_CODES = {"N": "[ACGTN]", "R": "[AG]", "Y": "[CT]", "W": "[AT]", "S": "[CG]", "K": "[GT]", "M": "[AC]"}


def binnify(spark: SparkSession, genome: Genome, binsize: int) -> DataFrame:
    """Fixed-width bins; the last of each sequence ends with it."""
    if binsize <= 0:
        raise ValueError("the bin size must be positive")
    offsets = genome.fixed_offsets(binsize)
    rows = [(i, n, x, offsets[i], offsets[i + 1] - offsets[i]) for i, (n, x) in enumerate(genome.sizes) if x > 0]
    chroms = small_table(spark, rows, "chrom_id int, chrom string, length long, first long, n long")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")
    start = F.col("k") * binsize
    return chroms.select("*", k).select((F.col("first") + F.col("k")).alias("bin_id"), "chrom_id", "chrom", start.alias("start"), F.least(start + binsize, F.col("length")).alias("end"))


def bins_from_edges(edges: DataFrame, genome: Genome) -> DataFrame:
    """Numbered bins from rows (chrom, start, end): ids follow the enumeration of the genome and the starts."""
    spark = edges.sparkSession
    chroms = genome.chroms(spark).select("chrom_id", F.col("name").alias("chrom"))
    rows = edges.select("chrom", F.col("start").cast("long"), F.col("end").cast("long")).join(chroms, "chrom")
    counts = {r["chrom_id"]: r["n"] for r in rows.groupBy("chrom_id").agg(F.count("*").alias("n")).collect()}  # a row a sequence
    first, offsets = 0, []
    for i in range(len(genome.sizes)):
        offsets.append((i, first))
        first += counts.get(i, 0)
    place = F.row_number().over(Window.partitionBy("chrom_id").orderBy("start", "end")) - 1
    numbered = rows.withColumn("_k", place).join(small_table(spark, offsets, "chrom_id int, _first long"), "chrom_id")
    return numbered.select((F.col("_first") + F.col("_k")).cast("long").alias("bin_id"), *(f.name for f in BINS.fields[1:]))


def check_bins(bins: DataFrame, genome: Genome) -> DataFrame:
    """The bins, or ValueError unless they cut exactly the genome's sequences, each from 0 to its length without gaps or overlaps."""
    per = bins.withColumn("_w", F.col("end") - F.col("start")).groupBy("chrom_id", "chrom")
    found = {(r["chrom_id"], r["chrom"]): (r["lo"], r["hi"], r["w"], r["bad"]) for r in per.agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.sum("_w").alias("w"), F.sum((F.col("_w") <= 0).cast("int")).alias("bad")).collect()}  # a row a sequence
    want = {(i, n): (0, x, x, 0) for i, (n, x) in enumerate(genome.sizes) if x > 0}
    if found != want:
        raise ValueError("the bins do not cover the sequences")
    following = Window.partitionBy("chrom_id").orderBy("bin_id")
    if bins.withColumn("_next", F.lead("start").over(following)).where(F.col("_next") != F.col("end")).take(1):
        raise ValueError("bins overlap, leave gaps or are out of order")
    return bins


def restriction_bins(sequences: DataFrame, genome: Genome, enzyme: str) -> DataFrame:
    """Fragments between an enzyme's cuts in (name, sequence) rows. An edge lies one base after the 1-based position of the first base behind a cut."""
    if enzyme not in ENZYMES:
        raise ValueError(f"unknown enzyme: {enzyme}")
    site, cut = ENZYMES[enzyme]
    pattern = re.compile("(?=" + "".join(_CODES.get(c, c) for c in site) + ")")

    def fragments(batches):
        import pandas as pd

        for batch in batches:
            for name, sequence in zip(batch["name"], batch["sequence"]):
                edges = [0, *(m.start() + cut + 2 for m in pattern.finditer(sequence.upper())), len(sequence)]
                edges = [e for e in edges if e <= len(sequence)]
                yield pd.DataFrame({"chrom": name, "start": edges[:-1], "end": edges[1:]})

    return bins_from_edges(sequences.select("name", "sequence").mapInPandas(fragments, "chrom string, start long, end long"), genome)


def relative_ids(bins: DataFrame, base: int = 0) -> DataFrame:
    """Bins with ``rel_id``, counted in each sequence from ``base`` on."""
    first = bins.groupBy("chrom_id").agg(F.min("bin_id").alias("_first"))
    return bins.join(first, "chrom_id").withColumn("rel_id", F.col("bin_id") - F.col("_first") + base).drop("_first")


def chromsizes_of(bins: DataFrame) -> Genome:
    """Sequences and their sizes, from each one's last bin."""
    rows = bins.groupBy("chrom_id").agg(F.max_by("chrom", "bin_id").alias("chrom"), F.max_by("end", "bin_id").alias("length")).orderBy("chrom_id").collect()  # a row a sequence
    return Genome(tuple((r["chrom"], r["length"]) for r in rows))


def bin_widths(bins: DataFrame) -> DataFrame:
    """The distinct widths of all bins but each sequence's last."""
    last = bins.groupBy("chrom_id").agg(F.max("bin_id").alias("_last"))
    return bins.join(last, "chrom_id").where(F.col("bin_id") < F.col("_last")).select((F.col("end") - F.col("start")).alias("width")).distinct()


def binsize_of(bins: DataFrame) -> int | None:
    """The width that all bins but each sequence's last share; None if there is no such width, or no such bin."""
    widths = [r["width"] for r in bin_widths(bins).limit(2).collect()]
    return int(widths[0]) if len(widths) == 1 else None


def mean_width(bins: DataFrame) -> float:
    """The mean width of the bins, as of restriction fragments."""
    return bins.agg(F.avg(F.col("end") - F.col("start"))).first()[0]


def chrom_offsets(bins: DataFrame) -> DataFrame:
    """(chrom_id, chrom, offset, n_bins)."""
    return bins.groupBy("chrom_id", "chrom").agg(F.min("bin_id").alias("offset"), F.count("*").alias("n_bins"))


def bin1_offsets(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """(bin_id, offset): pixels whose bin1_id is lower, for every bin and for the number of bins.

    Running sums stay inside a sequence; sequences' totals, a row each, are added to them.
    """
    counts = pixels.groupBy(F.col("bin1_id").alias("bin_id")).agg(F.count("*").alias("n"))
    per_bin = bins.select("bin_id", "chrom_id").join(counts, "bin_id", "left").select("bin_id", "chrom_id", F.coalesce("n", F.lit(0)).alias("n"))
    totals = per_bin.groupBy("chrom_id").agg(F.sum("n").alias("t"), F.max("bin_id").alias("last"))
    order = Window.orderBy("chrom_id")
    bases = totals.select("chrom_id", "last", F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("through"), "t")
    inside = Window.partitionBy("chrom_id").orderBy("bin_id").rowsBetween(Window.unboundedPreceding, -1)
    running = per_bin.select("bin_id", "chrom_id", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("before"))
    starts = running.join(bases, "chrom_id").select("bin_id", (F.col("before") + F.col("through") - F.col("t")).cast("long").alias("offset"))
    end = bases.agg((F.max("last") + 1).alias("bin_id"), F.max("through").cast("long").alias("offset"))
    return starts.union(end)


def run_lengths(rows: DataFrame, value: str, order: str, within: str | None = None) -> DataFrame:
    """Runs of equal values in an order: (within,) first position, length, value. Without ``within`` runs are found inside ranges of
    the order, a task each, and those that meet at the edges, a row or so a range, are joined afterwards."""
    marked = rows.select(*([within] if within else []), F.col(order).alias("_o"), F.col(value).alias("_v"))
    if within:
        return _runs(marked, [within]).drop("_run")
    dealt = checkpointed(marked.repartitionByRange("_o").withColumn("_p", F.spark_partition_id()))  # a range's number stays its own
    inside = _runs(dealt, ["_p"]).drop("_run")
    edge = Window.orderBy("start")
    last = Window.partitionBy("_p")
    outer = inside.withColumn("_edge", (F.col("start") == F.min("start").over(last)) | (F.col("start") == F.max("start").over(last)))
    at_edges = outer.where("_edge").withColumn("_new", (~F.col("value").eqNullSafe(F.lag("value").over(edge)) | F.lag("start").over(edge).isNull() | (F.lag("_p").over(edge) == F.col("_p"))).cast("int"))
    joined = at_edges.withColumn("_run", F.sum("_new").over(edge)).groupBy("_run").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.min_by("value", "start").alias("value"))
    return outer.where(~F.col("_edge")).select("start", "length", "value").union(joined.select("start", "length", "value"))


def _runs(marked: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("_o")
    change = (~F.col("_v").eqNullSafe(F.lag("_v").over(w)) | F.lag("_o").over(w).isNull()).cast("int")
    runs = marked.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w))
    return runs.groupBy(*keys, "_run").agg(F.min("_o").alias("start"), F.count("*").alias("length"), F.first("_v").alias("value"))


def piecewise(column: Column, pieces: Sequence[tuple[int, Column]]) -> Column:
    """The piece whose first value is the last one not above the column, by halving; pieces are sorted by their first value."""
    if len(pieces) == 1:
        return pieces[0][1]
    half = len(pieces) // 2
    return F.when(column < pieces[half][0], piecewise(column, pieces[:half])).otherwise(piecewise(column, pieces[half:]))


def sequence_starts(bins: DataFrame) -> list[tuple[int, int, int]]:
    """(first bin, chrom_id, number of bins) of every sequence, in order."""
    rows = bins.groupBy("chrom_id").agg(F.min("bin_id").alias("first"), F.count("*").alias("n")).collect()  # a row a sequence
    return sorted((r["first"], r["chrom_id"], r["n"]) for r in rows)


def overlapping(bins: DataFrame, intervals: DataFrame) -> DataFrame:
    """Bins that overlap any interval (chrom, start, end)."""
    bad = intervals.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return bins.join(bad, (F.col("chrom") == F.col("_c")) & (F.col("end") > F.col("_s")) & (F.col("start") < F.col("_e")), "left_semi")


def bins_in_region(bins: DataFrame, genome: Genome, region) -> DataFrame:
    """Bins that a half-open region touches."""
    name, start, end = genome.region(region)
    return bins.where((F.col("chrom") == name) & (F.col("end") > start) & (F.col("start") < end))


def extent_of(bins: DataFrame, genome: Genome, region, binsize: int | None = None) -> tuple[int, int]:
    """Half-open range of bin ids that a region touches: by arithmetic for fixed bins, else from the bin table. An empty region gives an empty range at its place, inside its bin."""
    if binsize:
        return genome.fixed_extent(region, binsize)
    name, start, end = genome.region(region)
    own = bins.where(F.col("chrom") == name)
    lo, hi = own.agg(F.max(F.when(F.col("start") <= start, F.col("bin_id"))), F.min(F.when(F.col("start") >= end, F.col("bin_id")))).first()
    if hi is None:
        hi = own.agg(F.max("bin_id")).first()[0] + 1
    return int(lo), int(hi)


def median_and_mad(rows: DataFrame, column: str) -> tuple[float, float]:
    """Exact median, and median distance from it."""
    middle = rows.agg(F.median(column)).first()[0]
    if middle is None:
        return float("nan"), float("nan")
    return middle, rows.agg(F.median(F.abs(F.col(column) - F.lit(middle)))).first()[0]
