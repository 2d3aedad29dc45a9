from __future__ import annotations

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from weftmap import cli
from weftmap.functions import bins as B
from weftmap.operators import ingest as I
from weftmap.operators.balance import balance
from weftmap.plans.genome import Genome
from weftmap.sources import collection as C
from weftmap.sources import text as T
from weftmap.streaming import ingest as S

GENOME = Genome.of({"a": 95, "b": 60})


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(4)
    at = lambda: (c := rng.choice("aab"), rng.randrange(GENOME.chromsizes[c]))
    return [(*at(), *at()) for _ in range(300)]


@pytest.fixture(scope="module")
def bins(spark):
    return B.binnify(spark, GENOME, 5)


@pytest.fixture(scope="module")
def pixels(spark, pairs):
    return I.pixels_from_pairs(spark.createDataFrame(pairs, "chrom1 string, pos1 long, chrom2 string, pos2 long"), GENOME, binsize=5).cache()


@pytest.fixture(scope="module")
def stored(spark, bins, pixels, tmp_path_factory):
    uri = f"{tmp_path_factory.mktemp('m')}/one"
    return C.create(uri, bins, pixels, genome=GENOME, assembly="toy", metadata={"k": [1]})


def test_round_trip_and_handle(spark, stored, bins, pixels):
    m = C.ContactMatrix(spark, stored.uri)
    assert rows(m.pixels()[:]) == [r for r in rows(pixels) if r[0] < m.info["nnz"]] == rows(pixels)
    assert rows(m.bins()[:]) == rows(bins) and m.binsize == 5 and m.chromsizes == GENOME.chromsizes and m.shape == (31, 31)
    assert m.info["sum"] == 300 and m.info["nnz"] == pixels.count() and m.info["metadata"] == {"k": [1]} and m.info["genome-assembly"] == "toy"
    assert m.extent("b") == (19, 31) and m.offset("a:12-30") == 2
    assert rows(m.bins()["start"].fetch("b:0-11")) == [(0,), (5,), (10,)]
    assert rows(m.pixels().fetch("a:0-20")) == [r for r in rows(pixels) if r[0] < 4]
    assert len(m.bins()) == 31 and "start" in m.bins() and m.bins()[-1].first().bin_id == 30
    with pytest.raises(IndexError):
        m.bins()[31]
    with pytest.raises(ValueError):
        m.bins()[::2]
    with pytest.raises(KeyError):
        C.ContactMatrix(spark, stored.uri + "::/none")


def test_matrix_selection(stored, pixels):
    full = {(a, b): n for a, b, n in rows(pixels)} | {(b, a): n for a, b, n in rows(pixels)}
    for region, other, box in (("a", None, (0, 19, 0, 19)), ("b:5-40", "a:0-50", (20, 27, 0, 10))):
        want = sorted((a, b, n) for (a, b), n in full.items() if box[0] <= a < box[1] and box[2] <= b < box[3])
        assert rows(stored.matrix(balance=False).fetch(region, other)) == want
        assert rows(stored.matrix(balance=False)[box[0] : box[1], box[2] : box[3]]) == want
    assert rows(stored.matrix(balance=False, as_pixels=True)[0:5, 0:9]) == [r for r in rows(pixels) if r[0] < 5 and r[1] < 9]
    assert stored.matrix(balance=False, join=True).fetch("a").columns == ["chrom1", "start1", "end1", "chrom2", "start2", "end2", "count"]
    assert stored.matrix(balance=False, dense=True)[0:4].count() == 4 * 31
    with pytest.raises(ValueError):
        stored.matrix().fetch("a")
    with pytest.raises(IndexError):
        stored.matrix(balance=False)[0:1, 0:1, 0:1]


def test_create_checks(spark, bins, pixels, tmp_path):
    with pytest.raises(I.InvalidPairs):
        C.create(f"{tmp_path}/x", bins, pixels.unionByName(pixels))
    assert C.create(f"{tmp_path}/x", bins, pixels.unionByName(pixels), duplicates=False).info["sum"] == 600
    with pytest.raises(ValueError):
        C.create(f"{tmp_path}/y", bins, pixels, columns=["nothing"])
    with pytest.raises(ValueError):
        C.create(f"{tmp_path}/y", bins.drop("end"), pixels)
    with pytest.raises(ValueError):
        C.create(f"{tmp_path}/y", bins, pixels, storage={"no": "such"})
    square = C.create(f"{tmp_path}/sq", bins, spark.createDataFrame([(5, 1, 2.7)], "bin1_id long, bin2_id long, count double"), symmetric=False, dtypes={"count": "int"})
    assert rows(square.matrix(balance=False)[:]) == [(5, 1, 2)]


def test_columns_and_names(spark, bins, pixels, tmp_path):
    m = C.create(f"{tmp_path}/m", bins, pixels, genome=GENOME)
    extra = bins.select("bin_id", (F.col("bin_id") * 2).alias("gc"))
    m.append("bins", extra)
    assert rows(m.bins()["gc"][:3]) == [(0,), (2,), (4,)]
    with pytest.raises(ValueError):
        m.append("bins", extra)
    m.append("bins", extra.withColumn("gc", F.lit(1)), force=True)
    assert rows(m.bins()["gc"][:2]) == [(1,), (1,)]
    m.delete_columns("bins", ["gc"])
    assert "gc" not in m.bins()
    m.store_balance(balance(m.pixels_frame, m.bins_frame, min_nnz=0, mad_max=0, tol=1e-2, max_iters=50))
    assert m.matrix().fetch("a").columns == ["bin1_id", "bin2_id", "count", "balanced"] and "scale" in m.info["columns"]["weight"]
    m.rename_chroms({"a": "one"})
    assert m.chromnames == ["one", "b"] and m.bins().fetch("one").count() == 19
    with pytest.raises(ValueError):
        m.rename_chroms({"one": "b"})


def test_merge_coarsen_zoomify(spark, stored, pixels, tmp_path):
    two = C.merge(spark, f"{tmp_path}/two", [stored.uri, stored.uri])
    assert two.info["sum"] == 600 and two.info["genome-assembly"] == "toy"
    half = C.coarsen(spark, stored.uri, f"{tmp_path}/half", 2)
    assert half.binsize == 10 and half.info["sum"] == 300
    with pytest.raises(ValueError):
        C.merge(spark, f"{tmp_path}/bad", [stored.uri, half.uri])
    groups = C.zoomify(spark, [stored.uri], f"{tmp_path}/multi", [10, 20])
    assert groups == ["/resolutions/5", "/resolutions/10", "/resolutions/20"] and C.is_multires(spark, f"{tmp_path}/multi")
    made = C.ContactMatrix(spark, f"{tmp_path}/multi::/resolutions/10")
    assert rows(made.pixels_frame) == rows(half.pixels_frame)


def test_cells(spark, bins, pixels, tmp_path):
    cells = pixels.withColumn("cell", F.when(F.col("bin1_id") < 9, "x").otherwise("y"))
    own = bins.select(F.lit("x").alias("cell"), "bin_id", F.lit(0.5).alias("weight"))
    C.create_cells(f"{tmp_path}/c", bins, cells, genome=GENOME, cell_bins=own)
    assert C.is_cells(spark, f"{tmp_path}/c") and C.list_cells(spark, f"{tmp_path}/c") == ["x", "y"]
    b, p = C.read_cell(spark, f"{tmp_path}/c", "x")
    assert rows(p, "bin1_id", "bin2_id", "count") == [r for r in rows(pixels) if r[0] < 9] and b.where("weight = 0.5").count() == 31
    with pytest.raises(KeyError):
        C.read_cell(spark, f"{tmp_path}/c", "z")


def test_file_operations(spark, bins, pixels, tmp_path):
    box = f"{tmp_path}/box"
    C.create(f"{box}::/g/m10", bins, pixels)
    C.copy(spark, f"{box}::/g/m10", f"{box}::/g/m2")
    C.copy(spark, f"{box}::/g/m2", f"{box}::/g/m3", rename=True)
    C.copy(spark, f"{box}::/g/m3", f"{box}::/l", soft=True)
    assert C.list_matrices(spark, box) == ["/g/m3", "/g/m10"]
    assert C.ContactMatrix(spark, f"{box}::/l").info["sum"] == 300
    assert C.is_matrix(spark, f"{box}::/g/m3") and not C.is_matrix(spark, box)
    with pytest.raises(ValueError):
        C.copy(spark, f"{box}::/g/m3", f"{box}::/g/m10")
    with pytest.raises(OSError):
        C.copy(spark, f"{box}::/g/m3", f"{tmp_path}/other::/x", link=True)
    with pytest.raises(ValueError):
        C.copy(spark, f"{box}::/g/m3", f"{box}::/q", link=True, soft=True)
    with pytest.raises(KeyError):
        C.copy(spark, f"{box}::/nothing", f"{box}::/q")
    assert "bin1_id: bigint" in C.tree(spark, box) and "pixels" not in C.tree(spark, box, 1)
    assert "nbins: 31" in C.attributes(spark, f"{box}::/g/m3")


def test_text_sources(spark, tmp_path):
    (tmp_path / "sizes").write_text("c10\t7\nc2\t5\nother\t3\nc1\t9\n")
    assert T.read_chromsizes(spark, str(tmp_path / "sizes"), [r"^c\d+$"]).sizes == (("c1", 9), ("c2", 5), ("c10", 7))
    assert T.read_chromsizes(spark, str(tmp_path / "sizes"), all_names=True).sizes[0] == ("c10", 7)
    (tmp_path / "x.bed").write_text("chrom\tstart\tend\nb\t0\t4\nb\t4\t9\na\t0\t3\n")
    genome, bins, size = T.parse_bins(spark, str(tmp_path / "x.bed"))
    assert genome.sizes == (("b", 9), ("a", 3)) and size is None and rows(bins, "bin_id", "chrom", "start")[0] == (0, "b", 0)
    with gzip.open(tmp_path / "p.gz", "wt") as f:
        f.write("## header\nr#1\ta\t3\tb\t4\t0.5\nr2\tb\t1\ta\t2\t1.5\n")
    found = T.read_pairs(spark, str(tmp_path / "p.gz"), 2, 3, 4, 5, {"v": (6, "double")})
    assert rows(found) == [("a", 3, "b", 4, 0.5), ("b", 1, "a", 2, 1.5)]
    (tmp_path / "f.fa").write_text(">a x\nACGT\nAC\n>b\nTT\n")
    assert rows(T.read_fasta(spark, str(tmp_path / "f.fa"))) == [("a", "ACGTAC"), ("b", "TT")]
    with pytest.raises(ValueError):
        T.read_fasta(spark)
    assert T.parse_field("v=7:dtype=float32,agg=mean") == ("v", 7, "float32", "mean") and T.parse_field("v") == ("v", None, None, None)
    for bad in ("=3", "v=x", "v=0", "v:no=1", "v:dtype=what"):
        with pytest.raises(ValueError):
            T.parse_field(bad)
    arrays = spark.createDataFrame([(0, 5, 1, 2)], "chrms1 int, cuts1 int, chrms2 int, cuts2 int")
    assert rows(T.read_hic_arrays(arrays, genome)) == [(0, 5, 1, 2)]
    with pytest.raises(ValueError):
        T.read_hic_arrays(spark.createDataFrame([(1, 5, 0, 2)], arrays.schema), genome)


def test_command_line(spark, pairs, pixels, tmp_path, capsys):
    (tmp_path / "sizes").write_text("a\t95\nb\t60\n")
    (tmp_path / "pairs").write_text("#h\n" + "".join(f"{a}\t{x + 1}\t{b}\t{y + 1}\n" for a, x, b, y in pairs))
    sizes, out = str(tmp_path / "sizes"), str(tmp_path / "m")

    def run(*args):
        code = cli.main([str(a) for a in args], spark)
        return code, capsys.readouterr().out

    assert run("cload", f"{sizes}:5", tmp_path / "pairs", out)[0] == 0
    assert run("info", out, "-f", "sum")[1] == "300\n" and run("info", out, "-f", "none")[0] == 1
    assert json.loads(run("info", out)[1])["nbins"] == 31
    dumped = [tuple(map(int, line.split("\t"))) for line in run("dump", out)[1].splitlines()]
    assert dumped == rows(pixels)
    assert run("dump", out, "-t", "chroms", "-H")[1] == "name\tlength\na\t95\nb\t60\n"
    joined = run("dump", out, "--join", "-r", "b", "--fill-lower", "--one-based-starts")[1].splitlines()
    assert joined and all(line.split("\t")[0] == "b" and int(line.split("\t")[1]) % 5 == 1 for line in joined)
    (tmp_path / "coo").write_text("".join(f"{a + 1}\t{b + 1}\t{n}\n" for a, b, n in dumped))
    (tmp_path / "bg2").write_text("".join(line + "\n" for line in run("dump", out, "--join")[1].splitlines()))
    assert run("load", "-f", "coo", "--one-based", f"{sizes}:5", tmp_path / "coo", tmp_path / "m2")[0] == 0
    assert run("load", "-f", "bg2", f"{sizes}:5", tmp_path / "bg2", tmp_path / "m3")[0] == 0
    for other in ("m2", "m3"):
        assert rows(C.ContactMatrix(spark, str(tmp_path / other)).pixels_frame) == dumped
    assert run("makebins", sizes, "40", "-i", "1")[1].splitlines()[:3] == ["a\t0\t40\t1", "a\t40\t80\t2", "a\t80\t95\t3"]
    assert run("balance", out, "--min-nnz", 0, "--mad-max", 0, "--tol", "0.1")[0] == 0
    assert run("balance", out, "--check")[0] == 0 and run("balance", out)[0] == 1
    assert run("merge", tmp_path / "mm", out, tmp_path / "m2")[0] == 0 and run("coarsen", out, "-k", 2, "-o", tmp_path / "k2")[0] == 0
    assert run("zoomify", out, "-r", "10,20", "-o", tmp_path / "z")[0] == 0
    assert run("ls", tmp_path / "z")[1].split() == ["/resolutions/5", "/resolutions/10", "/resolutions/20"]
    (tmp_path / "sortable").write_text("b\t3\ta\t5\na\t9\ta\t2\nzz\t1\ta\t1\n")
    assert run("csort", tmp_path / "sortable", sizes)[1] == "a\t2\ta\t9\na\t5\tb\t3\n"


def test_streams(spark, pairs, pixels, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.tsv").write_text("".join(f"{a}\t{x}\t{b}\t{y}\n" for a, x, b, y in pairs[k::3]))
    stream = S.stream_pixels(S.stream_pairs(spark, str(source)), GENOME, 5)
    q = stream.writeStream.format("memory").queryName("px").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("px")) == rows(pixels)
    q = S.fold_batches(S.stream_pairs(spark, str(source)), GENOME, 5, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(S.folded(spark, f"{tmp_path}/out")) == rows(pixels)


def test_streams_refuse_positions_outside(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("a\t5\ta\t7\na\t150\tb\t1\n")
    for k, outside in enumerate(("drop", "raise")):
        q = S.fold_batches(S.stream_pairs(spark, str(source)), GENOME, 5, f"{tmp_path}/out{k}", f"{tmp_path}/cp{k}", outside=outside).trigger(availableNow=True).start()
        if outside == "raise":
            with pytest.raises(StreamingQueryException):
                q.awaitTermination()
        else:
            q.awaitTermination()
            assert S.folded(spark, f"{tmp_path}/out{k}").collect()[0]["count"] == 1


def test_sources_survive(spark, bins, pixels, tmp_path):
    at = f"file://{tmp_path}/m"
    m = C.create(at, bins, pixels, genome=GENOME)
    want = sorted(tuple(r) for r in m.pixels_frame.collect())
    again = C.create(at, m.bins_frame, m.pixels_frame, genome=m.genome)
    assert sorted(tuple(r) for r in again.pixels_frame.collect()) == want
    with pytest.raises(I.InvalidPairs):  # a refused matrix changes nothing
        C.create(at, again.bins_frame, again.pixels_frame.union(again.pixels_frame), genome=m.genome)
    assert sorted(tuple(r) for r in C.ContactMatrix(spark, at).pixels_frame.collect()) == want
    box = f"file://{tmp_path}/box"
    C.copy(spark, at, f"{box}::/fine")
    with pytest.raises(ValueError, match="source"):
        C.coarsen(spark, f"{box}::/fine", f"{box}::/coarse", 2)
    C.coarsen(spark, f"{box}::/fine", f"{box}::/coarse", 2, mode="a")
    assert C.list_matrices(spark, box) == ["/coarse", "/fine"]
    assert sorted(tuple(r) for r in C.ContactMatrix(spark, f"{box}::/fine").pixels_frame.collect()) == want
    C.merge(spark, f"{box}::/twice", [f"{box}::/fine", at], mode="a")
    assert C.ContactMatrix(spark, f"{box}::/twice").info["sum"] == 2 * m.info["sum"] and len(C.list_matrices(spark, box)) == 3
    C.zoomify(spark, [f"{box}::/fine"], box, [m.binsize * 2])
    assert C.list_matrices(spark, box) == [f"/resolutions/{m.binsize}", f"/resolutions/{m.binsize * 2}"]
    assert [p.name for p in tmp_path.iterdir() if "." in p.name] == []


def test_cells_keep_their_names(spark, bins, pixels, tmp_path):
    named = pixels.select(F.lit("01").alias("cell"), "*").unionByName(pixels.limit(3).select(F.lit("1").alias("cell"), "*"))
    C.create_cells(f"file://{tmp_path}/cells", bins, named, genome=GENOME)
    assert C.list_cells(spark, f"file://{tmp_path}/cells") == ["01", "1"]
    assert C.read_cell(spark, f"file://{tmp_path}/cells", "01")[1].count() == pixels.count() and C.read_cell(spark, f"file://{tmp_path}/cells", "1")[1].count() == 3


def test_reductions_by_command(spark, bins, pixels, tmp_path):
    at, out = f"file://{tmp_path}/m", f"file://{tmp_path}/many"
    C.create(at, bins, pixels.withColumn("score", F.col("count") * 1.5), genome=GENOME)
    assert cli.main(["coarsen", at, "-k", "2", "-o", f"file://{tmp_path}/c", "--field", "count:dtype=float", "--field", "score:agg=max"], spark) == 0
    assert C.ContactMatrix(spark, f"file://{tmp_path}/c").pixels().dtypes["count"] == "double"
    size = C.ContactMatrix(spark, at).binsize
    assert cli.main(["zoomify", at, "-r", f"{2 * size}", "-o", out, "--base-uri", f"file://{tmp_path}/c", "--balance-args", "--min-nnz 0 --mad-max 0 --max-iters 3 --name w"], spark) == 0
    assert all("w" in C.ContactMatrix(spark, f"{out}::{g}").bins_frame.columns for g in C.list_matrices(spark, out))
    assert cli.main(["zoomify", at, "--legacy", "-o", f"{out}2"], spark) == 0 and "/0" in C.list_matrices(spark, f"{out}2")
    assert cli.main(["merge", f"{out}::/sum", at, at, "-a"], spark) == 0 and "/sum" in C.list_matrices(spark, out)


def test_names_of_the_package():
    import weftmap

    assert all(callable(getattr(weftmap, name)) for name in weftmap.__all__)


def test_boxes_in_chunks(stored):
    selector = stored.matrix(balance=False)
    chunks = selector.chunks((2, 13, 0, 20), 4)
    assert len(chunks) == chunks.n_chunks == 3
    assert sorted(r for c in chunks for r in rows(c)) == rows(selector.box((2, 13, 0, 20)))
    with pytest.raises(IndexError):
        chunks.get_chunk(3)
