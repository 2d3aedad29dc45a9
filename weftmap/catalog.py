"""The registered queries on the driver's tables, each with an equivalent in SQL.

A small genome is derived from ``part`` (five sequences, position = key div 5), contacts from ``lineitem`` (items of one order).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bins as B
from .operators import balance as BL
from .operators import ingest as I
from .operators import query as Q
from .operators import reduce as R
from .operators.pipe import split
from .plans.genome import Genome, small_table
from .plans.regions import natural_sorted, parse_number
from .plans.resolutions import parse_resolutions, preferred_sequence, quad_tile_depth
from .sources import collection as C
from .sources import text as T
from .sources.files import Files
from .sources.scratch import checkpointed, scratch_path
from .sources.tasks import dealt, tasks_for
from .streaming import ingest as S

BINSIZE, NCHROMS = 7, 5
Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        name = f.__name__.strip("_")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


# --- the tables as a genome and contacts


def genome(spark: SparkSession, sf_dir: str) -> Genome:
    top = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.max("p_partkey")).first()[0]
    return Genome(tuple((f"chr{i}", (top + 1) // NCHROMS) for i in range(NCHROMS)))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items of one order, in the order of their lines."""
    items = dealt(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"), "l_orderkey")
    a = items.select("l_orderkey", F.col("l_linenumber").alias("n1"), F.col("l_partkey").alias("k1"), F.col("l_quantity").alias("score"), F.col("l_returnflag").alias("cell"))
    b = items.select("l_orderkey", F.col("l_linenumber").alias("n2"), F.col("l_partkey").alias("k2"))
    pairs = a.join(b, "l_orderkey").where(F.col("n1") < F.col("n2"))
    side = lambda k: [(F.col(f"k{k}") % NCHROMS).cast("int").alias(f"chrom{k}"), F.floor(F.col(f"k{k}") / NCHROMS).alias(f"pos{k}")]
    return pairs.select("l_orderkey", *side("1"), *side("2"), "score", "cell")


def sanitized(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return I.sanitize_records(records(spark, sf_dir), genome(spark, sf_dir), **{"binsize": BINSIZE, "decode_chroms": False, **options})


def pixels(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return I.aggregate_records(sanitized(spark, sf_dir) if rows is None else rows, {"score": "sum"})


def fixed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.binnify(spark, genome(spark, sf_dir), BINSIZE)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("bin1_id", "bin2_id", "count")


def variable_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths 3, 11 and 5 in turn."""
    g = genome(spark, sf_dir)
    chroms = g.chroms(spark).select(F.col("name").alias("chrom"), "length", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / 19).cast("int"))).alias("r"))
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 3), (3, 14), (14, 19))))).alias("s")
    edges = chroms.select("chrom", "length", "r", steps).select("chrom", (F.col("r") * 19 + F.col("s.a")).alias("start"), F.least(F.col("r") * 19 + F.col("s.b"), F.col("length")).alias("end"))
    return B.bins_from_edges(edges.where(F.col("start") < F.col("end")), g)


def weighted_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins with a made-up weight; every 13th is masked."""
    return fixed_bins(spark, sf_dir).withColumn("weight", F.when(F.col("bin_id") % 13 == 0, F.lit(float("nan"))).otherwise(1.0 / (1 + F.col("bin_id") % 4)))


def blacklist(spark: SparkSession) -> DataFrame:
    return small_table(spark, [("chr1", 20, 40), ("chr3", 0, 7), ("chr4", 33, 34)], "chrom string, start long, end long")


_PRE = """
with g as (select (max(p_partkey)+1)//5 as len from part),
k as (select len, cast(ceil(len/7.0) as bigint) nb from g),
bins as (select c*nb+i as bin_id, c as chrom_id, 'chr'||c as chrom, i*7 as start, least(i*7+7,len) as "end" from k, range(5) a(c), range(100000) b(i) where i<nb),
pairs as (select a.l_orderkey, a.l_partkey%5 c1, a.l_partkey//5 p1, b.l_partkey%5 c2, b.l_partkey//5 p2, a.l_quantity score, a.l_returnflag cell
  from lineitem a join lineitem b on a.l_orderkey=b.l_orderkey and a.l_linenumber<b.l_linenumber),
rec as (select l_orderkey, cell, score, c1*nb+p1//7 r1, c2*nb+p2//7 r2, (c1>c2 or (c1=c2 and p1>p2)) as low from pairs, k),
px as (select least(r1,r2) bin1_id, greatest(r1,r2) bin2_id, count(*) as "count", sum(score) score from rec group by 1,2)
"""
_PX = 'cast(bin1_id as bigint) bin1_id, cast(bin2_id as bigint) bin2_id, cast("count" as bigint) as "count"'
_VAR = """, vb0 as (select c, r*19+a as s, least(r*19+b,len) e from k, range(5) x(c), range(100000) y(r), (values (0,3),(3,14),(14,19)) z(a,b) where r<=len//19 and r*19+a<least(r*19+b,len)),
vb as (select row_number() over (order by c,s)-1 as bin_id, c as chrom_id, 'chr'||c as chrom, s as start, e as "end" from vb0)
"""
_W = """, wb as (select bin_id, chrom_id, chrom, start, "end", case when bin_id%13=0 then 'nan'::double else 1.0::double/(1+bin_id%4) end as weight from bins)
"""


# --- bins


@_query(_PRE + 'select cast(bin_id as bigint) bin_id, cast(chrom_id as int) chrom_id, chrom, cast(start as bigint) start, cast("end" as bigint) as "end" from bins')
def binnify_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_bins(spark, sf_dir)


@_query(_PRE + _VAR + 'select cast(bin_id as bigint) bin_id, cast(chrom_id as int) chrom_id, chrom, cast(start as bigint) start, cast("end" as bigint) as "end" from vb')
def binnify_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variable_bins(spark, sf_dir)


@_query(_PRE + 'select distinct cast("end"-start as bigint) as width from (select *, max(bin_id) over (partition by chrom_id) last from bins) where bin_id<last')
def get_binsize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bin_widths(fixed_bins(spark, sf_dir))


@_query(_PRE + 'select cast(chrom_id as int) chrom_id, chrom as name, cast(arg_max("end",bin_id) as bigint) length from bins group by 1,2')
def get_chromsizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chromsizes_of(fixed_bins(spark, sf_dir)).chroms(spark)


@_query(_PRE + 'select cast(chrom_id as int) chrom_id, chrom, cast(min(bin_id) as bigint) "offset", count(*) n_bins from bins group by 1,2')
def chrom_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chrom_offsets(fixed_bins(spark, sf_dir))


@_query(
    _PRE
    + """, n as (select bin_id, count(px.bin1_id) n from bins left join px on bin_id=bin1_id group by 1)
select cast(bin_id as bigint) bin_id, cast(coalesce(sum(n) over (order by bin_id rows between unbounded preceding and 1 preceding),0) as bigint) "offset" from n
union all select cast((select count(*) from bins) as bigint), cast((select count(*) from px) as bigint)"""
)
def bin1_offset_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bin1_offsets(pixels(spark, sf_dir), fixed_bins(spark, sf_dir))


@_query(_PRE + _VAR + "select chrom, cast(bin_id-min(bin_id) over (partition by chrom_id)+1 as bigint) rel_id from vb")
def relative_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.relative_ids(variable_bins(spark, sf_dir), 1).select("chrom", "rel_id")


@_query(
    """with e as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) p from events),
r as (select *, sum(case when p is not distinct from event_type then 0 else 1 end) over (partition by user_id order by event_id rows unbounded preceding) run from e)
select user_id, min(event_id) "start", count(*) "length", any_value(event_type) "value" from r group by user_id, run"""
)
def run_length_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.run_lengths(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "event_id", within="user_id")


@_query(_PRE + """select cast(bin_id as bigint) bin_id from bins where exists (select 1 from (values ('chr1',20,40),('chr3',0,7),('chr4',33,34)) b(c,s,e) where c=chrom and "end">s and start<e)""")
def blacklist_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.overlapping(fixed_bins(spark, sf_dir), blacklist(spark)).select("bin_id")


@_query(_PRE + """select cast(min(bin_id) as bigint) lo, cast(max(bin_id)+1 as bigint) hi from bins where chrom='chr2' and "end">10 and start<33""")
def region_extent_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([genome(spark, sf_dir).fixed_extent("chr2:10-33", BINSIZE)], "lo long, hi long")


@_query(_PRE + _VAR + """select cast(min(bin_id) as bigint) lo, cast(max(bin_id)+1 as bigint) hi from vb where chrom='chr2' and "end">10 and start<33""")
def region_extent_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([B.extent_of(variable_bins(spark, sf_dir), genome(spark, sf_dir), "chr2:10-33")], "lo long, hi long")


@_query(_PRE + """select cast(bin_id as bigint) bin_id, chrom, cast(start as bigint) start, cast("end" as bigint) as "end" from bins where chrom='chr2' and "end">10 and start<33""")
def bins_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bins_in_region(fixed_bins(spark, sf_dir), genome(spark, sf_dir), ("chr2", 10, 33)).select("bin_id", "chrom", "start", "end")


# --- ingest


@_query(_PRE + "select cast(r1 as bigint) bin1_id, cast(r2 as bigint) bin2_id, score from rec")
def assign_bins_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitized(spark, sf_dir, triangle=None).select("bin1_id", "bin2_id", "score")


@_query(_PRE + _VAR + "select cast(a.bin_id as bigint) bin1_id, cast(b.bin_id as bigint) bin2_id, score from pairs join vb a on a.chrom_id=c1 and p1>=a.start and p1<a.end join vb b on b.chrom_id=c2 and p2>=b.start and p2<b.end")
def assign_bins_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitized(spark, sf_dir, triangle=None, binsize=None, bins=variable_bins(spark, sf_dir)).select("bin1_id", "bin2_id", "score")


@_query(_PRE + "select cast(case when low then r2 else r1 end as bigint) bin1_id, cast(case when low then r1 else r2 end as bigint) bin2_id, score from rec")
def sanitize_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitized(spark, sf_dir).select("bin1_id", "bin2_id", "score")


@_query(_PRE + "select cast(r1 as bigint) bin1_id, cast(r2 as bigint) bin2_id, score from rec where not low")
def sanitize_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitized(spark, sf_dir, triangle="drop").select("bin1_id", "bin2_id", "score")


@_query(_PRE + 'select cast(r1 as bigint) bin1_id, cast(r2 as bigint) bin2_id, count(*) as "count" from rec group by 1,2')
def sanitize_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.aggregate_records(sanitized(spark, sf_dir, triangle=None))


@_query(_PRE + f"select {_PX} from px")
def aggregate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.aggregate_records(sanitized(spark, sf_dir))


@_query(_PRE + 'select cast(least(r1,r2) as bigint) bin1_id, cast(greatest(r1,r2) as bigint) bin2_id, count(*) as "count", sum(score) as total, round(avg(score),6) as mean, min(score) as low, max(score) as high from rec group by 1,2')
def aggregate_sum_mean_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sanitized(spark, sf_dir).select("bin1_id", "bin2_id", F.col("score").alias("total"), F.col("score").alias("mean"), F.col("score").alias("low"), F.col("score").alias("high"))
    return I.aggregate_records(rows, {"total": "sum", "mean": "mean", "low": "min", "high": "max"}).withColumn("mean", F.round("mean", 6))


@_query(_PRE + 'select cast(least(r1,r2) as bigint) bin1_id, cast(greatest(r1,r2) as bigint) bin2_id, median(score) as score, count(distinct cell) as cell from rec group by 1,2')
def aggregate_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.aggregate_records(sanitized(spark, sf_dir), {"score": "median", "cell": "nunique"}, count=False)


@_query(_PRE + 'select cast(r1 as bigint) bin1_id, cast(r2 as bigint) bin2_id, count(*) as n from rec group by 1,2 having count(*)>1')
def dedupe_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.duplicate_pixels(sanitized(spark, sf_dir, triangle=None))


@_query("""with q as (select 'chr'||(a.l_partkey%5) c1, a.l_partkey//5 p1, 'chr'||(b.l_partkey%5) c2, b.l_partkey//5 p2 from lineitem a join lineitem b on a.l_orderkey=b.l_orderkey and a.l_linenumber<b.l_linenumber),
f as (select *, (c1>c2 or (c1=c2 and p1>p2)) low from q)
select case when low then c2 else c1 end chrom1, cast(case when low then p2 else p1 end as bigint) pos1, case when low then c1 else c2 end chrom2, cast(case when low then p1 else p2 end as bigint) pos2 from f""")
def sort_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select(*(F.concat(F.lit("chr"), F.col(f"chrom{k}")).alias(f"chrom{k}") if c == "chrom" else F.col(f"pos{k}") for k in "12" for c in ("chrom", "pos")))
    return I.sort_pairs(rows, genome(spark, sf_dir))


@_query("select l_partkey%5 as chrom1, l_suppkey%5 as chrom2, count(*) n from lineitem group by 1,2")
def pair_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return I.pair_blocks(items.select((F.col("l_partkey") % 5).alias("chrom1"), (F.col("l_suppkey") % 5).alias("chrom2")))


@_query("""select vec_id bin1_id, cast(i-1 as bigint) bin2_id, embedding[i] as "count" from (select vec_id, embedding, unnest(range(1, len(embedding)+1)) i from embeddings) where embedding[i]<>0 and i-1>=vec_id""")
def array_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense matrix, a row of it a row, as pixels of its upper triangle."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return I.pixels_from_array(rows.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("values")))


@_query("""with p as (select l_partkey%40 r, l_suppkey%20 c, l_linenumber n from lineitem), b as (select r, 40+c c, n from p union all select least(r,c), greatest(r,c), n from (select r%20 r, c, n from p) where r<=c)
select cast(r as bigint) bin1_id, cast(c as bigint) bin2_id, n as "count" from b""")
def block_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a matrix over two sequences as pixels."""
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_partkey") % 40).alias("row"), (F.col("l_suppkey") % 20).alias("col"), F.col("l_linenumber").alias("count"))
    return I.pixels_from_blocks({("a", "a"): p.withColumn("row", F.col("row") % 20), ("b", "a"): p.select(F.col("col").alias("row"), F.col("row").alias("col"), "count")}, {"a": 0, "b": 40})


# --- queries


@_query(_PRE + f"select {_PX} from px where bin1_id in (select bin_id from bins where chrom='chr1' and \"end\">5 and start<30)")
def pixels_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = genome(spark, sf_dir).fixed_extent("chr1:5-30", BINSIZE)
    return Q.slice_rows(pixels(spark, sf_dir), "bin1_id", lo, hi).select("bin1_id", "bin2_id", "count")


def _box_sql(i0: int, i1: int, j0: int, j1: int, fill: bool) -> str:
    sql = _PRE + f"select {_PX} from px where bin1_id>={i0} and bin1_id<{i1} and bin2_id>={j0} and bin2_id<{j1}"
    if fill:
        sql += f' union all select cast(bin2_id as bigint), cast(bin1_id as bigint), cast("count" as bigint) from px where bin1_id<>bin2_id and bin2_id>={i0} and bin2_id<{i1} and bin1_id>={j0} and bin1_id<{j1}'
    return sql


@_query(_box_sql(10, 20, 5, 25, False))
def matrix_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.box(pixels(spark, sf_dir), (10, 20, 5, 25)).select("bin1_id", "bin2_id", "count")


def _filled(name: str, bounds: Q.Box) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Q.fill_lower(pixels(spark, sf_dir).select("bin1_id", "bin2_id", "count"), bounds)

    run.__name__ = f"matrix_fill_lower_{name}"
    _query(_box_sql(*bounds, True))(run)


for _name, _bounds in {"anchored": (5, 25, 5, 25), "offdiag": (2, 10, 15, 28), "overlap": (5, 18, 12, 27), "nested": (10, 15, 4, 28), "transposed": (15, 28, 2, 10)}.items():
    _filled(_name, _bounds)


@_query(
    _PRE
    + """, f as (select bin1_id, bin2_id, "count" from px union all select bin2_id, bin1_id, "count" from px where bin1_id<>bin2_id)
select cast(a.i as bigint) bin1_id, cast(b.i as bigint) bin2_id, cast(coalesce("count",0) as bigint) as "count" from range(4,16) a(i) cross join range(10,26) b(i) left join f on f.bin1_id=a.i and f.bin2_id=b.i"""
)
def matrix_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.dense(pixels(spark, sf_dir).select("bin1_id", "bin2_id", "count"), fixed_bins(spark, sf_dir), (4, 16, 10, 26))


_ANN = 'a.chrom chrom1, cast(a.start as bigint) start1, cast(a."end" as bigint) end1'


@_query(_PRE + f'select {_ANN}, b.chrom chrom2, cast(b.start as bigint) start2, cast(b."end" as bigint) end2, {_PX} from px join bins a on a.bin_id=bin1_id join bins b on b.bin_id=bin2_id')
def annotate_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.annotate(pixels(spark, sf_dir).select("bin1_id", "bin2_id", "count"), fixed_bins(spark, sf_dir))


@_query(_PRE + f'select {_ANN}, cast(bin1_id as bigint) bin1_id, cast("count" as bigint) as "count" from px left join (select * from bins where bin_id<20) a on a.bin_id=bin1_id')
def annotate_bin1_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.annotate(pixels(spark, sf_dir).select("bin1_id", "count"), fixed_bins(spark, sf_dir).where("bin_id < 20"))


@_query(_PRE + _W + f'select {_PX}, round(a.weight*b.weight*"count",6) balanced from px join wb a on a.bin_id=bin1_id join wb b on b.bin_id=bin2_id where not isnan(a.weight*b.weight)')
def balanced_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.balanced(pixels(spark, sf_dir).select("bin1_id", "bin2_id", "count"), weighted_bins(spark, sf_dir))
    return rows.where(~F.isnan("balanced")).withColumn("balanced", F.round("balanced", 6))


@_query(_PRE + _W + f'select {_PX}, round("count"/(a.weight*b.weight),6) balanced from px join wb a on a.bin_id=bin1_id join wb b on b.bin_id=bin2_id where not isnan(a.weight*b.weight)')
def balanced_divisive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.balanced(pixels(spark, sf_dir).select("bin1_id", "bin2_id", "count"), weighted_bins(spark, sf_dir).withColumnRenamed("weight", "KR"), "KR")
    return rows.where(~F.isnan("balanced")).withColumn("balanced", F.round("balanced", 6))


@_query(_PRE + f"select {_PX} from px, k where bin1_id//nb=bin2_id//nb")
def cis_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.cis(pixels(spark, sf_dir), fixed_bins(spark, sf_dir)).select("bin1_id", "bin2_id", "count")


@_query(_PRE + f"select {_PX} from px, k where bin1_id//nb<>bin2_id//nb")
def trans_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.trans(pixels(spark, sf_dir), fixed_bins(spark, sf_dir)).select("bin1_id", "bin2_id", "count")


@_query(_PRE + f"select {_PX} from px where abs(bin1_id-bin2_id)>=2")
def ignore_diags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.off_diagonal(pixels(spark, sf_dir), 2).select("bin1_id", "bin2_id", "count")


@_query(_PRE + 'select cast(bin2_id-bin1_id as bigint) distance, cast(sum("count") as bigint) as "count", count(*) n_pixels from px, k where bin1_id//nb=bin2_id//nb group by 1')
def distance_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.distance_decay(pixels(spark, sf_dir), fixed_bins(spark, sf_dir))


@_query(_PRE + 'select cast(bin1_id as bigint) bin1_id, cast(bin2_id as bigint) bin2_id, round(log2("count"),6) as "count" from px')
def scale_log2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.scaled(pixels(spark, sf_dir).select("bin1_id", "bin2_id", "count"), scale="log2").withColumn("count", F.round("count", 6))


# --- marginals and balancing


@_query(_PRE + 'select cast(b as bigint) bin_id, cast(sum("count") as bigint) total from (select unnest([bin1_id,bin2_id]) b, "count" from px) group by 1')
def marginals_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BL.marginals(pixels(spark, sf_dir)).select("bin_id", "total")


@_query(_PRE + "select cast(b as bigint) bin_id, count(*) nnz from (select unnest([bin1_id,bin2_id]) b from px) group by 1")
def marginals_nnz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BL.marginals(pixels(spark, sf_dir)).select("bin_id", "nnz")


@_query(
    _PRE
    + """, m as (select bins.bin_id, chrom_id, coalesce(s,0) m from bins left join (select b, sum("count") s from (select unnest([bin1_id,bin2_id]) b, "count" from px where abs(bin1_id-bin2_id)>=2) group by 1) on b=bin_id),
r as (select *, m/median(case when m>0 then m end) over (partition by chrom_id) r from m),
md as (select median(ln(r)) md from r where r>0), dv as (select median(abs(ln(r)-md)) dv from r, md where r>0)
select cast(bin_id as bigint) bin_id from r, md, dv where r<exp(md-5*dv)"""
)
def mad_max_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins that the balancing operator masks for their marginals alone, before any iteration."""
    found = BL.balance(_counts(spark, sf_dir), fixed_bins(spark, sf_dir), min_nnz=0, rescale=False, max_iters=0)
    return found.table(spark).where(F.isnan("weight")).select("bin_id")


def _balance_sql(kind: str, iterations: int) -> str:
    keep = {"all": "", "cis": " and bin1_id//nb=bin2_id//nb", "trans": " and bin1_id//nb<>bin2_id//nb"}[kind]
    cw = "1.0::double/(1-1.0/5)" if kind == "trans" else "1.0::double"
    sql = _PRE + f""", q as materialized (select bin1_id, bin2_id, "count" v from px, k where abs(bin1_id-bin2_id)>=2{keep}),
b0 as materialized (select bin_id, chrom_id, 1.0::double bias, {cw} cw from bins)"""
    part = "partition by chrom_id" if kind == "cis" else ""
    for i in range(iterations):
        sql += f""", e{i} as materialized (select u, sum(v*x.bias*x.cw*y.bias*y.cw) m from (select bin1_id, bin2_id, v, unnest([bin1_id,bin2_id]) u from q) join b{i} x on x.bin_id=bin1_id join b{i} y on y.bin_id=bin2_id group by 1),
b{i + 1} as materialized (select bin_id, chrom_id, bias/coalesce(nullif(coalesce(m,0)/avg(nullif(m,0)) over ({part}),0),1) bias, cw from b{i} left join e{i} on u=bin_id)"""
    return sql + f" select cast(bin_id as bigint) bin_id, round(bias,6) bias from b{iterations}"


_UNFILTERED = {"min_nnz": 0, "mad_max": 0, "rescale": False, "tol": 0.0, "max_iters": 5}


def _balanced(name: str, kind: str) -> None:
    options = {**_UNFILTERED, "cis_only": kind == "cis", "trans_only": kind == "trans"}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = BL.balance(_counts(spark, sf_dir), fixed_bins(spark, sf_dir), **options)
        return found.table(spark).select("bin_id", F.round("weight", 6).alias("bias"))

    def table(spark: SparkSession, sf_dir: str) -> DataFrame:
        found, _ = BL.balance_large(_counts(spark, sf_dir), fixed_bins(spark, sf_dir), **options)
        return found.select("bin_id", F.round("weight", 6).alias("bias"))

    run.__name__, table.__name__ = f"balance_{name}_k5", f"balance_table_{name}_k5"
    _query(_balance_sql(kind, 5))(run)
    _query(_balance_sql(kind, 5))(table)


for _name, _kind in {"genomewide": "all", "cis": "cis", "trans": "trans"}.items():
    _balanced(_name, _kind)


@_query()
def balance_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver loop until convergence, with all filters."""
    rows = pixels(spark, sf_dir).select("bin1_id", "bin2_id", "count")
    found = BL.balance(rows, fixed_bins(spark, sf_dir), blacklist=blacklist(spark), max_iters=50)
    return found.table(spark).withColumn("weight", F.round("weight", 6))


# --- reductions


def _coarse_sql(k: int, value: str) -> str:
    return _PRE + f"select cast((bin1_id//nb)*((nb+{k - 1})//{k})+(bin1_id%nb)//{k} as bigint) bin1_id, cast((bin2_id//nb)*((nb+{k - 1})//{k})+(bin2_id%nb)//{k} as bigint) bin2_id, {value} from px, k group by 1,2"


@_query(_coarse_sql(2, 'cast(sum("count") as bigint) as "count"'))
def coarsen_k2_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coarsen_pixels(pixels(spark, sf_dir), fixed_bins(spark, sf_dir), 2)


@_query(_coarse_sql(3, "round(avg(score),6) as score"))
def coarsen_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coarsen_pixels(pixels(spark, sf_dir), fixed_bins(spark, sf_dir), 3, ["score"], {"score": "mean"}).withColumn("score", F.round("score", 6))


@_query(
    _PRE
    + _VAR
    + """, vr as (select *, bin_id-min(bin_id) over (partition by chrom_id) rel from vb), vn as (select *, dense_rank() over (order by chrom_id, rel//3)-1 nid from vr),
vp as (select least(a.nid,b.nid) bin1_id, greatest(a.nid,b.nid) bin2_id, count(*) as "count" from pairs join vn a on a.chrom_id=c1 and p1>=a.start and p1<a.end join vn b on b.chrom_id=c2 and p2>=b.start and p2<b.end group by 1,2)
select """
    + _PX
    + " from vp"
)
def coarsen_k3_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = variable_bins(spark, sf_dir)
    rows = I.aggregate_records(sanitized(spark, sf_dir, binsize=None, bins=bins))
    return R.coarsen_pixels(rows, bins, 3)


@_query(_PRE + _VAR + """, vr as (select *, bin_id-min(bin_id) over (partition by chrom_id) rel from vb)
select cast(dense_rank() over (order by chrom_id, rel//3)-1 as bigint) bin_id, cast(chrom_id as int) chrom_id, chrom, cast(min(start) as bigint) start, cast(max("end") as bigint) as "end" from vr group by chrom_id, chrom, rel//3""")
def coarsen_bins_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coarsen_bins(variable_bins(spark, sf_dir), 3)


@_query(
    " union all ".join(
        f"select {r} as resolution, * from ({_PRE} select cast((bin1_id//nb)*((nb+{k - 1})//{k})+(bin1_id%nb)//{k} as bigint) bin1_id, cast((bin2_id//nb)*((nb+{k - 1})//{k})+(bin2_id%nb)//{k} as bigint) bin2_id, cast(sum(\"count\") as bigint) as \"count\" from px, k group by 1,2)"
        for r, k in ((7, 1), (14, 2), (28, 4), (42, 6))
    )
)
def zoomify_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = pixels(spark, sf_dir).select("bin1_id", "bin2_id", "count")
    levels = R.zoomify({BINSIZE: (fixed_bins(spark, sf_dir), base)}, [14, 28, 42], keep=lambda _, level: (level[0], checkpointed(level[1])))
    parts = [px.select(F.lit(r).alias("resolution"), "bin1_id", "bin2_id", "count") for r, (_, px) in levels.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = sanitized(spark, sf_dir)
    return [I.aggregate_records(rows.where(F.col("l_orderkey") % 2 == k), {"score": "sum"}) for k in (0, 1)]


@_query(_PRE + f"select {_PX} from px")
def merge_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_pixels(_halves(spark, sf_dir))


@_query(_PRE + ', h as (select l_orderkey%2 o, least(r1,r2) bin1_id, greatest(r1,r2) bin2_id, sum(score) score from rec group by 1,2,3) select cast(bin1_id as bigint) bin1_id, cast(bin2_id as bigint) bin2_id, round(avg(score),6) score from h group by 1,2')
def merge_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_pixels(_halves(spark, sf_dir), ["score"], {"score": "mean"}).withColumn("score", F.round("score", 6))


@_query(_PRE + """, f as (select bin1_id, bin2_id, "count" from px union all select bin2_id, bin1_id, "count" from px where bin1_id<>bin2_id),
x as (select min(bin_id) lo, max(bin_id) hi from bins where chrom='chr1' and "end">0 and start<30)
select a.chrom chrom1, cast(a.start as bigint) start1, cast(a."end" as bigint) end1, b.chrom chrom2, cast(b.start as bigint) start2, cast(b."end" as bigint) end2, cast("count" as bigint) as "count" from f, x join bins a on a.bin_id=bin1_id join bins b on b.bin_id=bin2_id where bin1_id between lo and hi and bin2_id between lo and hi""".replace("from f, x join", "from x, f join"))
def contact_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: from pairs to a symmetric, annotated box of the matrix."""
    g = genome(spark, sf_dir)
    extent = g.fixed_extent("chr1:0-30", BINSIZE)
    rows = pixels(spark, sf_dir).select("bin1_id", "bin2_id", "count")
    return Q.annotate(Q.fill_lower(rows, (*extent, *extent)), B.binnify(spark, g, BINSIZE), replace=True)


# --- stored and read back


_KEPT: dict[tuple[str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str) -> C.ContactMatrix:
    """The counts as a stored matrix, written once a session; queries that change one copy it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT or not C.is_matrix(spark, _KEPT[key]):
        _KEPT[key] = C.create(scratch_path(spark, "matrix"), fixed_bins(spark, sf_dir), _counts(spark, sf_dir), genome=genome(spark, sf_dir)).uri
    return C.ContactMatrix(spark, _KEPT[key])


def _copied(spark: SparkSession, sf_dir: str) -> C.ContactMatrix:
    path = scratch_path(spark, "copy")
    C.copy(spark, _stored(spark, sf_dir).uri, path)
    return C.ContactMatrix(spark, path)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(sanitized(spark, sf_dir), "bin1_id", "bin2_id").groupBy("cell", "bin1_id", "bin2_id").agg(F.count("*").alias("count"))


@_query(_PRE + f"""select {_PX} from px where bin1_id in (select bin_id from bins where chrom='chr1' and "end">3 and start<25) and bin2_id in (select bin_id from bins where chrom='chr2')""")
def stored_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a matrix, opened, and a box fetched by two regions."""
    return _stored(spark, sf_dir).matrix(balance=False).fetch("chr1:3-25", "chr2")


@_query(_PRE + """select 'sum' as k, cast(sum("count") as varchar) v from px union all select 'nnz', cast(count(*) as varchar) from px union all select 'nbins', cast((select count(*) from bins) as varchar) union all select 'bin-type', 'fixed' union all select 'bin-size', '7'
union all select 'nchroms', '5' union all select 'storage-mode', 'symmetric-upper'""")
def stored_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = _stored(spark, sf_dir).info
    return small_table(spark, [(k, str(info[k])) for k in ("sum", "nnz", "nbins", "bin-type", "bin-size", "nchroms", "storage-mode")], "k string, v string")


@_query(_coarse_sql(4, 'cast(sum("count") as bigint) as "count"'))
def stored_zoomify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pyramid written level by level, its top read back."""
    path = scratch_path(spark, "pyramid")
    C.zoomify(spark, [_stored(spark, sf_dir).uri], path, [14, 28])
    return C.ContactMatrix(spark, f"{path}::/resolutions/28").pixels()[:]


@_query(_PRE + """select cast(least(r1,r2) as bigint) bin1_id, cast(greatest(r1,r2) as bigint) bin2_id, count(*) as "count" from rec where cell='R' group by 1,2""")
def stored_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell of several written over the same bins."""
    path = scratch_path(spark, "cells")
    C.create_cells(path, fixed_bins(spark, sf_dir), _cells(spark, sf_dir), genome=genome(spark, sf_dir))
    return C.read_cell(spark, path, "R")[1]


@_query(_PRE + f"select {_PX} from px")
def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as one-based text, read again and aggregated."""
    path = scratch_path(spark, "pairs")
    rows = records(spark, sf_dir).select(*(c for k in "12" for c in (F.concat(F.lit("chr"), F.col(f"chrom{k}")), F.col(f"pos{k}") + 1)))
    rows.write.options(sep="\t", compression="gzip").csv(path)
    return I.pixels_from_pairs(T.read_pairs(spark, path), genome(spark, sf_dir), binsize=BINSIZE, one_based=True)


@_query(_PRE + f"select {_PX} from px")
def text_bg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels dumped with the positions of their bins, loaded again."""
    path = scratch_path(spark, "bg2")
    Q.annotate(pixels(spark, sf_dir).select("bin1_id", "bin2_id", "count"), fixed_bins(spark, sf_dir), ["chrom", "start", "end"], replace=True).write.options(sep="\t").csv(path)
    return I.pixels_from_bg2(T.read_bg2(spark, path), genome(spark, sf_dir), binsize=BINSIZE)


@_query(_PRE + 'select cell, cast(least(r1,r2) as bigint) bin1_id, cast(greatest(r1,r2) as bigint) bin2_id, count(*) as "count" from rec group by 1,2,3')
def scool_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of a store, each listed and read by name."""
    path = scratch_path(spark, "cells")
    C.create_cells(path, fixed_bins(spark, sf_dir), _cells(spark, sf_dir), genome=genome(spark, sf_dir))
    parts = [C.read_cell(spark, path, c)[1].select(F.lit(c).alias("cell"), "bin1_id", "bin2_id", "count") for c in C.list_cells(spark, path)]
    return _united(parts)


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_query(_PRE + "select cast(bin_id as bigint) bin_id, case chrom when 'chr0' then 'one' when 'chr4' then 'five' else chrom end chrom from bins")
def rename_chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _copied(spark, sf_dir)
    m.rename_chroms({"chr0": "one", "chr4": "five"})
    return m.bins()[["bin_id", "chrom"]][:]


@_query(_PRE + 'select a.chrom chrom1, cast(a.start+1 as bigint) start1, cast(a."end" as bigint) end1, b.chrom chrom2, cast(b.start+1 as bigint) start2, cast(b."end" as bigint) end2, cast("count" as bigint) as "count" from px join bins a on a.bin_id=bin1_id join bins b on b.bin_id=bin2_id where a.chrom=\'chr0\' and b.chrom=\'chr0\'')
def dump_one_based(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).dump(region="chr0", join=True, one_based_starts=True)


@_query(_PRE + 'select (select count(distinct chrom_id) from bins) nchroms, (select count(*) from bins) nbins, count(*) nnz, cast(sum("count") as bigint) as "sum" from px')
def collection_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = _stored(spark, sf_dir).info
    return small_table(spark, [tuple(info[k] for k in ("nchroms", "nbins", "nnz", "sum"))], "nchroms long, nbins long, nnz long, sum long")


@_query(_PRE + "select c chrom_id, 'chr'||c as name, cast(len as bigint) length from g, range(5) a(c)")
def stored_chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).chroms()[:]


@_query(_PRE + """select cast(bin_id as bigint) bin_id, cast(chrom_id as int) chrom_id, chrom, cast(start as bigint) start, cast("end" as bigint) as "end" from bins where chrom='chr2' and "end">3 and start<25""")
def stored_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).bins().fetch("chr2:3-25")


@_query(_PRE + """select a.chrom chrom1, cast(a.start as bigint) start1, cast(a."end" as bigint) end1, b.chrom chrom2, cast(b.start as bigint) start2, cast(b."end" as bigint) end2, cast(bin1_id as bigint) bin1_id, cast(bin2_id as bigint) bin2_id, cast("count" as bigint) as "count" from px join bins a on a.bin_id=bin1_id join bins b on b.bin_id=bin2_id where a.chrom='chr1'""")
def stored_pixels_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).pixels(join=True).fetch("chr1")


@_query(_PRE + "select chrom, cast(start as bigint) start from bins where bin_id between 5 and 19")
def stored_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).bins()[["chrom", "start"]][5:20]


@_query("select * from (values ('bins','bin_id','bigint'),('bins','chrom','string'),('bins','chrom_id','int'),('bins','end','bigint'),('bins','start','bigint'),('chroms','chrom_id','int'),('chroms','length','bigint'),('chroms','name','string'),('pixels','bin1_id','bigint'),('pixels','bin2_id','bigint'),('pixels','count','bigint')) t(tab, col, kind)")
def stored_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _stored(spark, sf_dir)
    return small_table(spark, [(t, c, k) for t in ("chroms", "bins", "pixels") for c, k in getattr(m, t)().dtypes.items()], "tab string, col string, kind string")


@_query(_PRE + "select 'chr'||c as region, cast(c*nb+2 as bigint) as \"offset\", cast(c*nb+2 as bigint) lo, cast(c*nb+5 as bigint) hi from k, range(5) a(c)")
def stored_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _stored(spark, sf_dir)
    return small_table(spark, [(c, m.offset((c, 15, 30)), *m.extent((c, 15, 30))) for c in m.chromnames], "region string, offset long, lo long, hi long")


@_query(_PRE + 'select cast(bin1_id as bigint) bin1_id, cast(bin2_id as bigint) bin2_id, cast("count" as double) as "count", cast(score as float) score from px')
def create_with_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns written in other types than they have, and read back."""
    path = scratch_path(spark, "typed")
    return C.create(path, fixed_bins(spark, sf_dir), pixels(spark, sf_dir), dtypes={"count": "double", "score": "float"}).pixels_frame


@_query(_PRE + f"select {_PX} from px")
def create_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in no order, in which pixels occur several times, summed while they are written."""
    parts = [p.select("bin1_id", "bin2_id", "count") for p in _halves(spark, sf_dir)]
    return C.create(scratch_path(spark, "unordered"), fixed_bins(spark, sf_dir), I.pixels_from_any(spark, parts), duplicates=False).pixels_frame


@_query(_PRE + f"select {_PX} from px where bin1_id<>bin2_id")
def create_over_itself(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix written over the one it is read from."""
    m = _copied(spark, sf_dir)
    return C.create(m.uri, m.bins_frame, Q.off_diagonal(m.pixels_frame, 1), genome=m.genome).pixels_frame


@_query(_PRE + """select 'at' as k, cast(sum("count") as bigint) s, count(*) n from px union all select 'coarse', (select cast(sum("count") as bigint) from px), (select count(*) from (select distinct (bin1_id//nb)*((nb+1)//2)+(bin1_id%nb)//2, (bin2_id//nb)*((nb+1)//2)+(bin2_id%nb)//2 from px, k))""")
def append_to_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarser matrix put beside its source in one container; both are there afterwards."""
    path = scratch_path(spark, "container")
    C.copy(spark, _stored(spark, sf_dir).uri, f"{path}::/at")
    C.coarsen(spark, f"{path}::/at", f"{path}::/coarse", 2, mode="a")
    return small_table(spark, [(g.strip("/"), i["sum"], i["nnz"]) for g in C.list_matrices(spark, path) for i in [C.ContactMatrix(spark, f"{path}::{g}").info]], "k string, s long, n long")


@_query(_PRE + """select cast(bin_id as bigint) bin_id, cast(bin_id%3 as bigint) part, case when bin_id between 10 and 19 then -1.0 else bin_id/2.0 end::double as half from bins""")
def append_and_put_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns added, rows of one overwritten from a place on, another deleted."""
    m = _copied(spark, sf_dir)
    m.append("bins", m.bins_frame.select("bin_id", (F.col("bin_id") % 3).alias("part"), (F.col("bin_id") / 2).alias("half"), F.lit(1).alias("gone")))
    m.put("bins", small_table(spark, [(i, -1.0) for i in range(10)], "row long, half double"), 10)
    m.delete_columns("bins", ["gone"])
    return m.bins_frame.drop("chrom_id", "chrom", "start", "end")


@_query(" union all ".join(f"select {r} as resolution, '/resolutions/{r}' as name" for r in (7, 14, 28)))
def list_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a container in natural order."""
    path = scratch_path(spark, "pyramid")
    groups = C.zoomify(spark, [_stored(spark, sf_dir).uri], path, [14, 28])
    return small_table(spark, [(C.ContactMatrix(spark, f"{path}::{g}").binsize, g) for g in groups], "resolution int, name string")


# --- text and other inputs


@_query(_PRE + f"select {_PX} from px")
def text_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples with one-based ids, half of them turned over, written as text and loaded again."""
    path = scratch_path(spark, "coo")
    rows = _counts(spark, sf_dir).select((F.col("bin1_id") + 1).alias("a"), (F.col("bin2_id") + 1).alias("b"), "count")
    odd = F.col("a") % 2 == 1
    rows.select(F.when(odd, F.col("b")).otherwise(F.col("a")), F.when(odd, F.col("a")).otherwise(F.col("b")), "count").write.options(sep="\t").csv(path)
    return I.sanitize_pixels(T.read_coo(spark, path), one_based=True)


def _sizes_file(spark: SparkSession, sf_dir: str) -> str:
    path = f"{scratch_path(spark, 'sizes')}.txt"
    Files(spark).write(path, "".join(f"{n}\t{x}\n" for n, x in [*genome(spark, sf_dir).sizes, ("other_1", 5)]))
    return path


@_query(_PRE + "select cast(row_number() over (order by c desc)-1 as int) chrom_id, 'chr'||c as name, cast(len as bigint) length from g, (values (2),(1)) a(c)")
def text_chromsizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes read from a file, names that match a pattern only, in the order of the patterns."""
    return T.read_chromsizes(spark, _sizes_file(spark, sf_dir), [r"2$", r"^chr1$"]).chroms(spark)


@_query(_PRE + 'select cast(bin_id as bigint) bin_id, cast(chrom_id as int) chrom_id, chrom, cast(start as bigint) start, cast("end" as bigint) as "end" from bins union all select (select count(*) from bins), 5, \'other_1\', 0, 5')
def bins_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins given as a sizes file and a width."""
    return T.parse_bins(spark, f"{_sizes_file(spark, sf_dir)}:{BINSIZE}")[1]


@_query(_PRE + _VAR + 'select cast(bin_id as bigint) bin_id, cast(chrom_id as int) chrom_id, chrom, cast(start as bigint) start, cast("end" as bigint) as "end" from vb')
def bins_argument_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins given as a BED file."""
    path = scratch_path(spark, "bed")
    variable_bins(spark, sf_dir).orderBy("bin_id").coalesce(1).select("chrom", "start", "end").write.options(sep="\t").csv(path)
    return T.parse_bins(spark, path)[1]


@_query(_PRE + """select cast(bin_id as bigint) bin_id from bins where exists (select 1 from (values ('chr1',20,40),('chr3',0,7),('chr4',33,34)) b(c,s,e) where c=chrom and "end">s and start<e)""")
def text_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins that overlap intervals of a BED file with a header."""
    path = f"{scratch_path(spark, 'blacklist')}.bed"
    Files(spark).write(path, "track name=bad\n" + "".join(f"{r.chrom}\t{r.start}\t{r.end}\textra\n" for r in blacklist(spark).collect()))
    return B.overlapping(fixed_bins(spark, sf_dir), T.read_bed(spark, path)).select("bin_id")


@_query(_PRE + f"select {_PX} from px")
def hic_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as parallel columns of sequence numbers and positions."""
    upper = I.swap_where(records(spark, sf_dir), (F.col("chrom1") > F.col("chrom2")) | ((F.col("chrom1") == F.col("chrom2")) & (F.col("pos1") > F.col("pos2"))), [("chrom1", "chrom2"), ("pos1", "pos2")])
    rows = upper.select(F.col("chrom1").alias("chrms1"), F.col("pos1").alias("cuts1"), F.col("chrom2").alias("chrms2"), F.col("pos2").alias("cuts2"))
    return I.pixels_from_pairs(T.read_hic_arrays(rows, genome(spark, sf_dir)), genome(spark, sf_dir), binsize=BINSIZE, decode_chroms=False)


_SEQ = "q as (select p_partkey%5 c, string_agg(substr('GATC', 1+((p_partkey//5)%4+(p_size//17))%4, 1), '' order by p_partkey) s from part group by 1)"


@_query(f"""with {_SEQ}, e as (select c, 0 e, len(s) n from q union all select c, i+1, len(s) from q, range(1, 1000000) r(i) where i<=len(s) and substr(s,i,4)='GATC' and i+1<=len(s) union all select c, len(s), len(s) from q),
f as (select c, e as start, lead(e) over (partition by c order by e) as stop from e)
select cast(row_number() over (order by c, start, stop)-1 as bigint) bin_id, cast(c as int) chrom_id, 'chr'||c as chrom, cast(start as bigint) start, cast(stop as bigint) as "end" from f where stop is not null""")
def fasta_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as FASTA, read and cut."""
    letter = F.substring(F.lit("GATC"), (1 + (F.floor(F.col("p_partkey") / 5) % 4 + F.floor(F.col("p_size") / 17)) % 4).cast("int"), F.lit(1))
    letters = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % NCHROMS).alias("c"), F.struct("p_partkey", letter.alias("x")).alias("x"))
    record = F.concat(F.lit(">chr"), "c", F.lit(" made up\n"), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["x"]), ""))
    path = scratch_path(spark, "fasta")
    letters.groupBy("c").agg(F.collect_list("x").alias("l")).select("c", F.explode("l").alias("x")).groupBy("c").agg(record.alias("value")).select("value").write.text(path)
    return B.restriction_bins(T.read_fasta(spark, path), genome(spark, sf_dir), "DpnII")


# --- checks and filters of records and pixels


@_query(_PRE + "select count(*) n, cast(sum(p1+p2) as bigint) s from pairs where c1 not in (3,4) and c2 not in (3,4)")
def unknown_chroms_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of sequences that the genome does not have are left out."""
    fewer = Genome(genome(spark, sf_dir).sizes[:3])
    rows = I.sanitize_records(records(spark, sf_dir), fewer, binsize=BINSIZE, decode_chroms=False, triangle=None)
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("pos1") + F.col("pos2")).alias("s"))


@_query(_PRE + f"select {_PX} from px where bin1_id<>bin2_id")
def pixels_lower_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pixels and their mirror images the lower ones are left out."""
    upper = Q.off_diagonal(_counts(spark, sf_dir), 1)
    lower = upper.select(F.col("bin2_id").alias("bin1_id"), F.col("bin1_id").alias("bin2_id"), "count")
    return I.sanitize_pixels(upper.unionByName(lower), triangle="drop")


@_query("select true same, false cut, false shorter, false fewer")
def same_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins, variable = fixed_bins(spark, sf_dir), variable_bins(spark, sf_dir)
    other = variable.withColumn("end", F.when(F.col("bin_id") == 3, F.col("end") - 1).otherwise(F.col("end")))
    return small_table(spark, [(R.same_bins(variable, variable_bins(spark, sf_dir)), R.same_bins(bins, variable), R.same_bins(variable, other), R.same_bins(bins, bins.where("chrom_id < 4")))], "same boolean, cut boolean, shorter boolean, fewer boolean")


_BY = "l_orderkey, score, cell, r1, r2"


@_query(_PRE + f"""select cast(least(r1,r2) as bigint) bin1_id, cast(greatest(r1,r2) as bigint) bin2_id, round(stddev_samp(score),6) std, round(var_samp(score),6) var, round(ln(product(score)),6) logprod, first(score order by {_BY}) first_score, last(score order by {_BY}) last_score from rec group by 1,2""")
def aggregate_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread, product, first and last of each pixel's records."""
    rows = sanitized(spark, sf_dir, triangle=None).withColumnsRenamed({"bin1_id": "r1", "bin2_id": "r2"}).withColumns({"bin1_id": F.least("r1", "r2"), "bin2_id": F.greatest("r1", "r2")})
    rows = rows.withColumns({c: F.col("score") for c in ("std", "var", "logprod", "first_score", "last_score")})
    how = {"std": "std", "var": "var", "logprod": "prod", "first_score": "first", "last_score": "last"}
    out = I.aggregate_records(rows, how, count=False, order=_BY.split(", "))
    return out.withColumns({"std": F.round("std", 6), "var": F.round("var", 6), "logprod": F.round(F.log("logprod"), 6)})


@_query(_PRE + 'select cast(sum("count") as bigint) total, count(*) n from px')
def chunk_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks' sums folded to one."""
    total, n = split(_counts(spark, sf_dir)).pipe(lambda chunk: (int(chunk["count"].sum()), len(chunk))).reduce(lambda a, b: (a[0] + b[0], a[1] + b[1]), (0, 0))
    return small_table(spark, [(total, n)], "total long, n long")


@_query(_PRE + "select cast(bin1_id as bigint) bin1_id, cast(bin2_id as bigint) bin2_id, cast(max(score)-min(score) as double) score from (select least(r1,r2) bin1_id, greatest(r1,r2) bin2_id, score from rec) group by 1,2")
def aggregate_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of one's own as aggregate."""
    return I.aggregate_records(sanitized(spark, sf_dir), {"score": lambda c: F.max(c) - F.min(c)}, count=False)


# --- plans and streams


@_query("with s(style, start, stop) as (values ('nice',5,100),('nice',2,3000),('nice',1000,50000),('binary',3,50)) select style, start, cast(start*m*b as bigint) as value from s, (values (1),(2),(5)) x(m), (select cast(case when style='nice' then pow(10,i) else pow(2,i) end as bigint) b, style st from (values ('nice'),('binary')) y(style), range(12) z(i)) p where st=style and (style='nice' or m=1) and start*m*b<=stop")
def preferred_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [("nice", 5, 100), ("nice", 2, 3000), ("nice", 1000, 50_000), ("binary", 3, 50)]
    return small_table(spark, [(style, a, v) for style, a, b in cases for v in preferred_sequence(a, b, style)], "style string, start int, value long")


@_query("select unnest([1000,2000,5000,10000,25000,50000,100000,250000]) as value")
def standard_sequence_4dn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_table(spark, [(v,) for v in parse_resolutions("4DN", 1000, 300_000)], "value int")


@_query(_PRE + "select cast(greatest(0, ceil(log2(ceil(len*5/(4*7.0))))) as int) depth from g")
def tile_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_table(spark, [(quad_tile_depth(genome(spark, sf_dir).total, BINSIZE, tile=4),)], "depth int")


@_query(" union all ".join(f"select {d} as up, * from ({_PRE} select cast((bin1_id//nb)*((nb+{k - 1})//{k})+(bin1_id%nb)//{k} as bigint) bin1_id, cast((bin2_id//nb)*((nb+{k - 1})//{k})+(bin2_id%nb)//{k} as bigint) bin2_id, cast(sum(\"count\") as bigint) as \"count\" from px, k group by 1,2)" for d, k in ((0, 1), (1, 2), (2, 4))))
def legacy_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest three levels of the factor-2 pyramid, counted from the base upwards."""
    levels = R.zoom_levels(fixed_bins(spark, sf_dir), _counts(spark, sf_dir), keep=lambda _, level: (level[0], checkpointed(level[1])), tile=2)
    deepest = max(levels)
    return _united([levels[deepest - up][1].select(F.lit(up).alias("up"), "bin1_id", "bin2_id", "count") for up in range(3)])


@_query(_PRE + _VAR + "select round(avg(\"end\"-start),6) mean from vb")
def mean_bin_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_table(spark, [(round(B.mean_width(variable_bins(spark, sf_dir)), 6),)], "mean double")


@_query(_PRE + """, m as (select sum("count") m from (select unnest([bin1_id,bin2_id]) b, "count" from px where abs(bin1_id-bin2_id)>=2) group by b)
select round(avg(m),6) scale, round(var_pop(m),4) variance from m where m<>0""")
def balance_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and variance of the nonzero marginals, as the first iteration sees them."""
    found = BL.balance(_counts(spark, sf_dir), fixed_bins(spark, sf_dir), **{**_UNFILTERED, "max_iters": 1})
    return small_table(spark, [(round(found.stats["scale"], 6), round(found.stats["var"], 4))], "scale double, variance double")


@_query(_PRE + f"select {_PX} from px")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that arrive as files, folded batch by batch."""
    path, sizes = scratch_path(spark, "stream"), genome(spark, sf_dir)
    named = records(spark, sf_dir).select(*(c for k in "12" for c in (F.concat(F.lit("chr"), F.col(f"chrom{k}")), F.col(f"pos{k}"))))
    (named if tasks_for(named) else named.repartition(3)).write.options(sep="\t").csv(f"{path}/in")  # the join's tasks, or three files of a small table
    S.fold_batches(S.stream_pairs(spark, f"{path}/in"), sizes, BINSIZE, f"{path}/out", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return S.folded(spark, f"{path}/out").select("bin1_id", "bin2_id", "count")


@_query("select * from (values ('1,000',1000),('10M',10000000),('1.5kb',1500),('2g',2000000000)) t(said, number)")
def humanised_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_table(spark, [(t, parse_number(t)) for t in ("1,000", "10M", "1.5kb", "2g")], "said string, number long")


@_query("select * from (values ('chr2',0),('chr10',1),('chr10_alt',2),('chrX',3)) t(name, place)")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_table(spark, [(n, i) for i, n in enumerate(natural_sorted(["chrX", "chr10", "chr2", "chr10_alt"]))], "name string, place int")


@_query(_PRE + 'select cast(bin1_id as bigint) "row", cast(bin2_id-10 as bigint) col, cast("count" as bigint) as "value" from px where bin1_id<10 and bin2_id between 10 and 39')
def box_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box as arrays relative to it."""
    bounds = (0, 10, 10, 40)
    r, c, v = Q.to_arrays(Q.box(_counts(spark, sf_dir), bounds), bounds)
    return small_table(spark, list(zip(r.tolist(), c.tolist(), v.tolist())), "row long, col long, value long")


@_query(_PRE + """, s as (select chrom_id, case when bin_id%7<3 then 1 else 0 end v, bin_id from bins), c as (select *, case when v=lag(v) over (order by bin_id) then 0 else 1 end n from s), r as (select *, sum(n) over (order by bin_id) run from c)
select cast(min(bin_id) as bigint) start, count(*) length, max(v) as "value" from r group by run""")
def run_lengths_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over all bins, found range by range."""
    rows = fixed_bins(spark, sf_dir).select("bin_id", F.when(F.col("bin_id") % 7 < 3, 1).otherwise(0).alias("v"))
    return B.run_lengths(rows, "v", "bin_id")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
