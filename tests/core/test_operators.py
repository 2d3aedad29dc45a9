from __future__ import annotations

import itertools
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmap.functions import bins as B
from weftmap.operators import balance as BL
from weftmap.operators import ingest as I
from weftmap.operators import query as Q
from weftmap.operators import reduce as R
from weftmap.operators.pipe import split
from weftmap.plans.genome import Genome
from weftmap.sources.scratch import checkpointed

GENOME = Genome.of({"a": 95, "b": 60, "c": 7})
EDGES = {"a": [0, 6, 8, 40, 41, 95], "b": [0, 30, 60], "c": [0, 7]}


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


@pytest.fixture(scope="module")
def bins(spark):
    return B.binnify(spark, GENOME, 10)


@pytest.fixture(scope="module")
def variable(spark):
    return B.bins_from_edges(spark.createDataFrame([(c, s, e) for c, x in EDGES.items() for s, e in itertools.pairwise(x)], "chrom string, start long, end long"), GENOME)


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(1)
    at = lambda: (c := rng.choice(["a", "a", "b", "c"]), rng.randrange(GENOME.chromsizes[c]))
    return [(*at(), *at(), rng.choice("+-"), rng.choice("+-"), float(rng.randrange(9))) for _ in range(400)]


@pytest.fixture(scope="module")
def frame(spark, pairs):
    return spark.createDataFrame(pairs, "chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, v double")


@pytest.fixture(scope="module")
def pixels(frame):
    return I.pixels_from_pairs(frame, GENOME, {"v": "sum"}, binsize=10).cache()


def low(p):
    return (GENOME.ids[p[0]], p[1]) > (GENOME.ids[p[2]], p[3])


def flip(p):
    return (p[2], p[3], p[0], p[1], p[5], p[4], p[6])


def test_bins(spark, bins, variable):
    assert bins.count() == 10 + 6 + 1 and B.binsize_of(bins) == 10 and B.binsize_of(variable) is None
    assert B.chromsizes_of(bins) == GENOME == B.chromsizes_of(variable)
    assert rows(variable, "bin_id", "chrom", "start")[:3] == [(0, "a", 0), (1, "a", 6), (2, "a", 8)]
    assert rows(B.chrom_offsets(variable), "chrom_id", "offset", "n_bins") == [(0, 0, 5), (1, 5, 2), (2, 7, 1)]
    assert B.binsize_of(B.binnify(spark, GENOME, 100)) is None  # one bin a sequence
    bad = spark.createDataFrame([("a", 5, 10), ("b", 10, 20)], "chrom string, start long, end long")
    assert rows(B.overlapping(bins, bad), "bin_id") == [(0,), (11,)]
    for region in ("a:0-95", "a:7-9", "a:40-41", "b:0-1", "c"):
        name, start, end = GENOME.region(region)
        for table, size in ((bins, 10), (variable, None)):
            touched = [r.bin_id for r in table.collect() if r.chrom == name and r.end > start and r.start < end]
            assert B.extent_of(table, GENOME, region, size) == (min(touched), max(touched) + 1)


def test_restriction_fragments(spark):
    sequences = spark.createDataFrame([("a", "AAAA"), ("b", "TTGATCTTTTgatcT")], "name string, sequence string")
    g = Genome.of({"a": 4, "b": 15})
    assert rows(B.restriction_bins(sequences, g, "MboI"), "chrom", "start", "end") == [("a", 0, 4), ("b", 0, 4), ("b", 4, 12), ("b", 12, 15)]
    with pytest.raises(ValueError):
        B.restriction_bins(sequences, g, "NoSuch")


@pytest.mark.parametrize("action", ["reflect", "drop", None])
@pytest.mark.parametrize("kind", ["fixed", "variable"])
def test_sanitize_records(frame, pairs, variable, action, kind):
    options = {"binsize": 10} if kind == "fixed" else {"bins": variable}
    found = I.sanitize_records(frame, GENOME, triangle=action, sided=["strand"], **options)
    kept = [flip(p) if action == "reflect" and low(p) else p for p in pairs if not (action == "drop" and low(p))]
    off = GENOME.fixed_offsets(10)
    first = dict(zip(EDGES, np.cumsum([0, *(len(e) - 1 for e in EDGES.values())])))

    def bin_of(c, x):
        return off[GENOME.ids[c]] + x // 10 if kind == "fixed" else int(first[c] + np.searchsorted(EDGES[c], x, "right") - 1)

    names = ("chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "v", "bin1_id", "bin2_id")
    assert rows(found, *names) == sorted((*p, bin_of(p[0], p[1]), bin_of(p[2], p[3])) for p in kept)


def test_record_checks(spark):
    schema = "chrom1 string, pos1 long, chrom2 string, pos2 long"
    make = lambda *data: spark.createDataFrame(list(data), schema)
    assert I.sanitize_records(make(("a", 1, "zz", 1), ("a", 1, "b", 1)), GENOME, binsize=10).count() == 1
    assert rows(I.sanitize_records(make(("a", 1, "a", 11)), GENOME, binsize=10, one_based=True), "bin1_id", "bin2_id") == [(0, 1)]
    for bad in (("a", -1, "b", 1), ("a", 1, "b", 60), ("c", 8, "c", 1)):
        with pytest.raises(I.InvalidPairs):
            I.sanitize_records(make(bad), GENOME, binsize=10, eager=True)
        with pytest.raises(Exception, match="outside its sequence"):
            I.sanitize_records(make(bad), GENOME, binsize=10).collect()
    with pytest.raises(I.InvalidPairs):
        I.sanitize_records(make(("b", 1, "a", 1)), GENOME, binsize=10, triangle="raise", eager=True)
    with pytest.raises(ValueError):
        I.sanitize_records(make(("b", 1, "a", 1)), GENOME, binsize=10, triangle="other")
    assert I.sanitize_records(make(), GENOME, binsize=10).columns[-2:] == ["bin1_id", "bin2_id"]


def test_aggregates(spark):
    data = spark.createDataFrame([(0, 1, 2.0, 1), (0, 1, float("nan"), 2), (0, 1, 4.0, 3), (2, 2, float("nan"), 4)], "bin1_id long, bin2_id long, x double, o int")
    for how, one, two in (("sum", 6.0, 0.0), ("mean", 3.0, None), ("min", 2.0, None), ("max", 4.0, None), ("median", 3.0, None), ("count", 2, 0), ("nunique", 2, 0), ("prod", 8.0, 1.0), ("size", 3, 1)):
        found = {r.bin1_id: r for r in I.aggregate_records(data, {"x": how}).collect()}
        assert (found[0].x, found[2].x, found[0]["count"]) == (one, two, 3)
    ends = I.aggregate_records(data, {"x": "last"}, order=["o"]).where("bin1_id = 0").first()
    assert ends.x == 4.0
    assert I.aggregate_records(data, {"x": lambda c: F.sum(c * 2)}, rename={"x": "y"}).where("bin1_id = 0").first().y == 12.0
    with pytest.raises(ValueError):
        I.aggregate_records(data, {"x": "no such"})


def test_validation(spark):
    make = lambda *data: spark.createDataFrame(list(data), "bin1_id long, bin2_id long, count long")
    assert I.validate_pixels(make((0, 1, 1), (1, 1, 1)), 2).count() == 2
    for bad in ([(0, 2, 1)], [(-1, 0, 1)], [(1, 0, 1)], [(0, 1, 1), (0, 1, 2)]):
        with pytest.raises(I.InvalidPairs):
            I.validate_pixels(make(*bad), 2)
    assert rows(I.sanitize_pixels(make((2, 1, 5), (1, 1, 1)), one_based=True)) == [(0, 0, 1), (0, 1, 5)]
    assert rows(I.sanitize_pixels(make((2, 1, 5), (1, 1, 1)), triangle="drop")) == [(1, 1, 1)]


def test_array_and_block_inputs(spark):
    m = np.array([[1.0, 0, 2], [0, 3, 4], [2, 4, 0]])
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "row_id long, values array<double>")
    assert rows(I.pixels_from_array(frame)) == [(0, 0, 1.0), (0, 2, 2.0), (1, 1, 3.0), (1, 2, 4.0)]
    block = lambda *cells: spark.createDataFrame(list(cells), "row long, col long, count double")
    blocks = {("a", "a"): block((0, 0, 1.0), (1, 1, 3.0)), ("b", "a"): block((0, 0, 2.0), (0, 1, 4.0))}
    assert rows(I.pixels_from_blocks(blocks, {"a": 0, "b": 2})) == [(0, 0, 1.0), (0, 2, 2.0), (1, 1, 3.0), (1, 2, 4.0)]


def test_boxes_against_the_whole_matrix(spark):
    rng = np.random.default_rng(3)
    full = np.triu(rng.integers(0, 3, (9, 9)))
    data = spark.createDataFrame([(int(i), int(j), int(full[i, j])) for i, j in zip(*np.nonzero(full))], "bin1_id long, bin2_id long, count long").cache()
    sym = full + full.T - np.diag(np.diag(full))
    some = [(0, 9, 0, 9), (2, 5, 2, 5), (0, 3, 4, 8), (4, 8, 0, 3), (1, 6, 3, 9), (3, 9, 1, 6), (3, 5, 0, 9), (0, 9, 3, 5), (4, 4, 0, 9)]
    for b in some:
        i0, i1, j0, j1 = b
        assert (Q.to_matrix(Q.fill_lower(data, b), b) == sym[i0:i1, j0:j1]).all()
        assert (Q.to_matrix(Q.box(data, b), b) == full[i0:i1, j0:j1]).all()
        if i1 > i0:
            assert sum(r["count"] for r in Q.dense(data, None, b).collect()) == sym[i0:i1, j0:j1].sum()
            assert Q.dense(data, None, b).count() == (i1 - i0) * (j1 - j0)


def test_annotate_and_balance_values(spark, bins, pixels):
    full = Q.annotate(pixels, bins, ["chrom", "start"])
    assert full.columns == ["chrom1", "start1", "chrom2", "start2", *pixels.columns] and full.count() == pixels.count()
    assert Q.annotate(pixels, bins.where("bin_id < 3"), ["chrom"]).where("chrom1 is null").count() == pixels.where("bin1_id >= 3").count()
    weighted = bins.withColumn("weight", F.when(F.col("bin_id") == 1, float("nan")).otherwise(F.col("bin_id") + 1.0)).withColumn("KR", F.when(F.col("bin_id") == 2, 0.0).otherwise(2.0))
    for r in Q.balanced(pixels, weighted).collect():
        want = float("nan") if 1 in (r.bin1_id, r.bin2_id) else (r.bin1_id + 1) * (r.bin2_id + 1) * r["count"]
        assert r.balanced == want or (want != want and r.balanced != r.balanced)
    for r in Q.balanced(pixels, weighted, "KR").collect():
        assert r.balanced == (float("inf") if 2 in (r.bin1_id, r.bin2_id) else r["count"] / 4)
    with pytest.raises(ValueError):
        Q.balanced(pixels, bins)


def test_offsets_and_runs(spark, bins, pixels):
    counts = np.bincount([r.bin1_id for r in pixels.collect()], minlength=17)
    assert rows(B.bin1_offsets(pixels, bins)) == list(enumerate(np.concatenate([[0], np.cumsum(counts)]).tolist()))
    values = spark.createDataFrame([(i, v) for i, v in enumerate([1, 1, 2, None, None, 1])], "i long, v int")
    assert [tuple(r) for r in B.run_lengths(values, "v", "i").orderBy("start").collect()] == [(0, 2, 1), (2, 1, 2), (3, 2, None), (5, 1, 1)]


def test_coarsen_is_binning_anew(frame, bins, variable, pixels):
    again = I.pixels_from_pairs(frame, GENOME, binsize=30)
    assert rows(R.coarsen_pixels(pixels, bins, 3)) == rows(again, "bin1_id", "bin2_id", "count")
    assert rows(R.coarsen_bins(bins, 3), "bin_id", "chrom", "start", "end")[:5] == [(0, "a", 0, 30), (1, "a", 30, 60), (2, "a", 60, 90), (3, "a", 90, 95), (4, "b", 0, 30)]
    assert rows(R.coarsen_bins(variable, 2), "start", "end") == sorted([(0, 8), (8, 41), (41, 95), (0, 60), (0, 7)])
    levels = R.zoomify({10: (bins, pixels)}, [20, 40, 60])
    for size, (_, made) in levels.items():
        assert rows(made, "bin1_id", "bin2_id", "count") == rows(I.pixels_from_pairs(frame, GENOME, binsize=size), "bin1_id", "bin2_id", "count")


def test_merge(pixels, bins, variable):
    twice = R.merge_pixels([pixels, pixels], ["count", "v"])
    assert rows(twice) == [(a, b, 2 * n, 2 * v) for a, b, n, v in rows(pixels)]
    assert rows(R.merge_pixels([pixels, pixels], how={"count": "mean"})) == [(a, b, float(n)) for a, b, n, _ in rows(pixels)]
    with pytest.raises(ValueError):
        R.merge_pixels([pixels], ["nothing"])
    assert R.same_bins(bins, bins) and not R.same_bins(bins, variable) and R.same_bins(variable, variable)
    assert R.common_type(["int", "bigint"]) == "long" and R.common_type(["int", "float"]) == "double" and R.common_type(["smallint", "float"]) == "float"


def dense_of(pixels, weights=None, n=17):
    m = Q.to_matrix(Q.fill_lower(pixels, (0, n, 0, n)), (0, n, 0, n)).astype(float)
    return m if weights is None else m * np.outer(weights, weights)


def corrected(m, own, extra, tol):
    """Iterative correction of a dense matrix's rows ``own``, by hand."""
    bias = np.ones(len(m)) * (m.sum(axis=0) > 0)
    for _ in range(2000):
        w = bias * extra
        marg = (m * np.outer(w, w)).sum(axis=0)[own]
        mean, var = marg[marg != 0].mean(), marg[marg != 0].var()
        bias[own] /= np.where(marg == 0, 1, marg / mean)
        if var < tol:
            return bias[own] / mean**0.5
    raise AssertionError("no convergence")


@pytest.mark.parametrize("mode", ["all", "cis", "trans"])
def test_balance_against_dense_matrix(bins, pixels, mode):
    tol = 1e-4
    with warnings.catch_warnings():
        warnings.simplefilter("error", BL.ConvergenceWarning)
        found = BL.balance(pixels, bins, ignore_diags=0, min_nnz=0, mad_max=0, cis_only=mode == "cis", trans_only=mode == "trans", tol=tol, max_iters=2000)
    chrom = np.array([0] * 10 + [1] * 6 + [2])
    m = dense_of(pixels)
    np.fill_diagonal(m, 2 * np.diag(m))
    same = chrom[:, None] == chrom[None, :]
    m = m if mode == "all" else np.where(same == (mode == "cis"), m, 0)
    extra = 1 / (1 - np.array([10, 6, 1]) / 17)[chrom] if mode == "trans" else np.ones(17)
    parts = [np.flatnonzero(chrom == c) for c in range(3)] if mode == "cis" else [np.arange(17)]
    want = np.concatenate([corrected(m, own, extra, tol) for own in parts])
    assert found.stats["converged"] and np.allclose(found.weights, want, equal_nan=True)
    if mode == "all":
        w = np.nan_to_num(found.weights)
        assert np.allclose((m * np.outer(w, w)).sum(axis=0), 1, atol=1e-3)


def test_filters_and_warnings(spark, bins, pixels):
    bad = spark.createDataFrame([("a", 0, 15)], "chrom string, start long, end long")
    with pytest.warns(BL.ConvergenceWarning):
        found = BL.balance(pixels, bins, blacklist=bad, min_nnz=5, min_count=20, max_iters=1)
    marg = {r.bin_id: r for r in BL.marginals(Q.off_diagonal(pixels, 2)).collect()}
    for i, w in enumerate(found.weights):
        masked = i < 2 or i not in marg or marg[i].nnz < 5 or marg[i].total < 20
        if masked:
            assert np.isnan(w)
    nothing = BL.balance(pixels.limit(0), bins)
    assert np.isnan(nothing.weights).all() and nothing.stats["var"] == 0
    with pytest.raises(ValueError):
        BL.balance(pixels, bins, cis_only=True, trans_only=True)


@pytest.mark.parametrize("mode", ["all", "cis", "trans"])
def test_large_form_agrees(spark, bins, pixels, mode):
    bad = spark.createDataFrame([("a", 0, 15)], "chrom string, start long, end long")
    for options in ({"min_nnz": 0, "mad_max": 0}, {"min_nnz": 3, "min_count": 10, "mad_max": 2, "blacklist": bad}):
        options = {"tol": 1e-3, "cis_only": mode == "cis", "trans_only": mode == "trans", **options}
        weights, stats = BL.balance_large(pixels, bins, checkpointed, **options)
        small = BL.balance(pixels, bins, **options)
        large = np.array([r.weight for r in weights.orderBy("bin_id").collect()])
        assert stats["converged"] == small.stats["converged"] and np.allclose(large, small.weights, equal_nan=True)
        assert np.allclose(stats["scale"], small.stats["scale"], equal_nan=True)


def test_pipes(pixels):
    pipe = split(pixels.repartition(3))
    total = pipe.pipe(lambda chunk: chunk["count"].sum()).reduce(lambda a, b: a + b, 0)
    assert total == 400
    assert pipe.pipe(lambda chunk: len(chunk)).reduce(lambda acc, n: acc + [n], [], merge=lambda a, b: [sum(a) + sum(b)]) == [pixels.count()]
    made = pipe.prepare(lambda chunk: chunk["count"] * 0 + 1).pipe(lambda chunk, state, k: state * k, 2).pipe(lambda chunk, state: int(state.sum()))
    assert sum(made.gather()) == 2 * pixels.count()
    assert pipe.steps == ()
    table = pipe.pipe(lambda chunk: chunk[["bin1_id"]] + 1).table("bin1_id long")
    assert rows(table) == sorted((r.bin1_id + 1,) for r in pixels.collect())


def test_any_input_and_orientations(spark):
    import pandas as pd

    one = {"bin1_id": [0], "bin2_id": [1], "count": [5]}
    frame = I.pixels_from_any(spark, [one, pd.DataFrame(one), spark.createDataFrame([(1, 2, 3)], "bin1_id long, bin2_id long, count long")])
    assert rows(frame) == [(0, 1, 5), (0, 1, 5), (1, 2, 3)]
    with pytest.raises(ValueError):
        I.pixels_from_any(spark, [])
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b"), ("c", "a")], "chrom1 string, chrom2 string")
    assert I.one_orientation(pairs) is pairs
    with pytest.raises(I.InvalidPairs):
        I.one_orientation(pairs.unionByName(spark.createDataFrame([("b", "a")], pairs.schema)))


def test_many_sequences_are_told_by_joins(spark, bins, pixels, monkeypatch):
    from weftmap.operators import reduce as R

    few = [rows(f) for f in (Q.cis(pixels, bins), Q.trans(pixels, bins), R.coarsen_pixels(pixels, bins, 2), R.coarse_id(bins, 3))]
    for module in (Q, R):
        monkeypatch.setattr(module, "MOST_PIECES", 1)
    assert [rows(f) for f in (Q.cis(pixels, bins), Q.trans(pixels, bins), R.coarsen_pixels(pixels, bins, 2), R.coarse_id(bins, 3))] == few


def test_runs_meet_at_the_edges_of_ranges(spark):
    values = [(i, None if i % 9 == 0 else i // 40 % 3) for i in range(300)] + [(i, 5) for i in range(300, 900)]
    runs, want = B.run_lengths(spark.createDataFrame(values, "o long, v long").repartition(7), "v", "o"), []
    for i, v in values:
        if want and want[-1][2] == v:
            want[-1][1] += 1
        else:
            want.append([i, 1, v])
    assert sorted((r.start, r.length, r.value) for r in runs.collect()) == [tuple(w) for w in want]


def test_check_bins(bins, variable):
    assert B.check_bins(bins, GENOME) is bins and B.check_bins(variable, GENOME) is variable
    shorter = Genome.of({"a": 95, "b": 50, "c": 7})
    for bad, genome in ((bins, shorter), (bins.where("bin_id <> 2"), GENOME), (bins.withColumn("end", F.expr("if(bin_id = 2, end + 1, if(bin_id = 4, end - 1, end))")), GENOME)):
        with pytest.raises(ValueError):
            B.check_bins(bad, genome)


def test_custom_format(spark):
    from weftmap.sources.custom import register_format

    register_format(spark, "counting", "chrom1 string, pos1 long", lambda options: range(int(options["parts"])), lambda part, options: (("a", part * 10 + i) for i in range(2)))
    assert rows(spark.read.format("counting").option("parts", "3").load()) == [("a", x) for x in (0, 1, 10, 11, 20, 21)]
