"""Shuffles of records and pixels go to tasks whose number grows with the input, and the results stay those of the SQL."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from weftmap import catalog
from weftmap.sources import tasks

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def rows_of(found, columns):
    return sorted(tuple(str(round(float(r[c]), 5)) for c in columns) for r in found)


def equals_sql(name, found):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    want = con.execute(catalog.oracle_sql()[name])
    order = [d[0] for d in want.description]
    assert rows_of(found.collect(), found.columns) == rows_of([dict(zip(order, r)) for r in want.fetchall()], found.columns)


def least_tasks(frame):
    """The fewest tasks that a shuffle by both bins goes to."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return min(int(n) for n in re.findall(r"Exchange hashpartitioning\(_?bin1_id#\d+L?, _?bin2_id#\d+L?, (\d+)\)", plan))


@pytest.mark.parametrize("name", ["aggregate_count", "merge_sum", "merge_mean", "coarsen_k2_sum", "coarsen_mean", "dedupe_validate"])
def test_tasks_follow_the_input(spark, monkeypatch, name):
    size = (DATA / "lineitem.parquet").stat().st_size
    monkeypatch.setattr(tasks, "TASK_BYTES", size // 10)  # as a table of ten tasks, read twice
    found = catalog.queries()[name](spark, str(DATA))
    assert least_tasks(found) >= 20
    equals_sql(name, found)
    monkeypatch.setattr(tasks, "TASK_BYTES", size // 20)
    assert least_tasks(catalog.queries()[name](spark, str(DATA))) >= 40


def test_small_frames_keep_the_session_settings(spark):
    assert tasks.tasks_for(spark.read.parquet(str(DATA / "lineitem.parquet"))) is None
    assert tasks.tasks_for(spark.range(10)) is None


def pixels_of(spark, rows):
    return spark.createDataFrame(rows, "bin1_id long, bin2_id long, count long")


def test_sorted_files_are_checked_without_a_shuffle(spark, tmp_path):
    from weftmap.operators.ingest import strictly_rising

    rows = [(a, b, 1) for a in range(40) for b in range(a, 40)]
    parts = {"rising": [rows[:500], rows[500:]], "swapped": [rows[500:], rows[:500]], "inside": [[*rows[:9], rows[8], *rows[9:]]], "between": [rows[:500], rows[499:]], "unsorted": [[*rows[100:], *rows[:101]]], "overlapping": [rows[::2], rows[1::2]]}
    found = {}
    for name, files in parts.items():
        for part in files:
            pixels_of(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        found[name] = strictly_rising(spark.read.parquet(str(tmp_path / name)))
    pixels_of(spark, [(1, 2, 1), (None, 3, 1)]).coalesce(1).write.parquet(str(tmp_path / "null"))
    found["null"] = strictly_rising(spark.read.parquet(str(tmp_path / "null")))
    assert found == {"rising": True, "swapped": True, "inside": False, "between": False, "unsorted": False, "overlapping": False, "null": False}


@pytest.fixture
def plans(spark, monkeypatch):
    """The shuffles of pixels by hash that a stored matrix needs are counted by the checks it runs."""
    from weftmap.operators import ingest

    asked = []
    real = ingest.duplicate_pixels
    monkeypatch.setattr(ingest, "duplicate_pixels", lambda p: asked.append(1) or real(p))
    return asked


def test_stored_pixels_are_sorted_in_ranges_and_refused_when_repeated(spark, tmp_path, monkeypatch, plans):
    from weftmap.functions.bins import binnify
    from weftmap.operators.ingest import InvalidPairs
    from weftmap.plans.genome import Genome
    from weftmap.sources import collection as C

    genome = Genome.of({"a": 100, "b": 60})
    bins, rows = binnify(spark, genome, 2), [(a, b, 1) for a in range(80) for b in range(a, 80, 2)]
    monkeypatch.setattr(C, "SORTED_ROWS", len(rows) // 9)
    m = C.create(str(tmp_path / "m"), bins, pixels_of(spark, rows[::-1]), genome=genome)
    assert m.pixels_frame.count() == len(rows) and not plans  # no second shuffle of all pixels
    assert len(list((tmp_path / "m/pixels").glob("part-*"))) >= 9
    with pytest.raises(InvalidPairs, match="more than once"):
        C.create(str(tmp_path / "n"), bins, pixels_of(spark, [*rows, rows[7]]), genome=genome)
    with pytest.raises(InvalidPairs, match="out of bounds"):
        C.create(str(tmp_path / "n"), bins, pixels_of(spark, [*rows, (5, 80, 1)]), genome=genome)
    assert not (tmp_path / "n").exists()


def test_base_of_a_pyramid_is_copied_and_still_checked(spark, tmp_path):
    from weftmap.functions.bins import binnify
    from weftmap.operators.ingest import InvalidPairs
    from weftmap.plans.genome import Genome
    from weftmap.sources import collection as C

    genome = Genome.of({"a": 40, "b": 60})
    rows = [(a, b, a + 1) for a in range(50) for b in range(a, 50, 3)]
    m = C.create(str(tmp_path / "m"), binnify(spark, genome, 2), pixels_of(spark, rows), genome=genome)
    assert C.zoomify(spark, [m.uri], str(tmp_path / "z"), [4]) == ["/resolutions/2", "/resolutions/4"]
    names = lambda p: sorted(f.name for f in p.glob("part-*.parquet"))
    assert names(tmp_path / "m/pixels") == names(tmp_path / "z/resolutions/2/pixels")
    base = C.ContactMatrix(spark, f"{tmp_path}/z::/resolutions/2")
    assert sorted(map(tuple, base.pixels_frame.collect())) == sorted(rows) and base.info["sum"] == sum(r[2] for r in rows)
    loose = C.create(str(tmp_path / "l"), binnify(spark, genome, 2), pixels_of(spark, [*rows, (3, 99, 1)]), genome=genome, bounds=False)
    with pytest.raises(InvalidPairs, match="out of bounds"):
        C.zoomify(spark, [loose.uri], str(tmp_path / "y"), [4])


def test_rows_count_where_bytes_are_few(spark, tmp_path, monkeypatch):
    spark.range(2_000_000).selectExpr("id div 1000 as bin1_id").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(tasks, "_COUNTED", 1000)
    monkeypatch.setattr(tasks, "TASK_ROWS", 100_000)
    assert sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet")) < tasks.TASK_BYTES
    assert tasks.tasks_for(t) == 20 and tasks.tasks_for(t.union(t)) == 40
    assert tasks.dealt(t, "bin1_id").rdd.getNumPartitions() == 20


def test_dump_is_in_order_from_many_tasks(spark, tmp_path, monkeypatch):
    from weftmap.functions.bins import binnify
    from weftmap.plans.genome import Genome
    from weftmap.sources import collection as C

    genome = Genome.of({"a": 100, "b": 60})
    rows = [(a, b, 1) for a in range(80) for b in range(a, 80, 2)]
    m = C.create(str(tmp_path / "m"), binnify(spark, genome, 2), pixels_of(spark, rows), genome=genome)
    monkeypatch.setattr(tasks, "TASK_BYTES", 100)
    found = m.dump(region="a", join=True)
    assert found.rdd.getNumPartitions() > 9
    assert [(r["start1"] // 2, r["start2"] // 2) for r in found.collect()] == [r[:2] for r in rows if r[1] < 50]


def test_streamed_batches_follow_the_input(spark, monkeypatch):
    from weftmap.streaming import ingest as S

    size = (DATA / "lineitem.parquet").stat().st_size
    monkeypatch.setattr(tasks, "TASK_BYTES", size // 10)
    asked = []
    real = S.dealt
    monkeypatch.setattr(S, "dealt", lambda df, *keys: asked.append(tasks.tasks_for(df)) or real(df, *keys))
    found = catalog.queries()["stream_counts"](spark, str(DATA))
    equals_sql("stream_counts", found)
    assert len(asked) == 2 and asked[0]  # a batch's text has a known size


def test_sums_step_over_all_bins_once_for_as_many_pixels(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from weftmap.operators import balance as BL

    rng, n = np.random.default_rng(1), 300_000
    a, b, v, w = rng.integers(0, n, 20_000), rng.integers(0, n, 20_000), rng.random(20_000), rng.random(n)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 100]) for x in (a, b, v)], names=["bin1_id", "bin2_id", "_v"]) for i in range(0, 20_000, 100)]
    calls, real = [], np.bincount
    monkeypatch.setattr(BL.np, "bincount", lambda *x, **y: calls.append(1) or real(*x, **y))
    found = BL._added(iter(batches), n, w, "_v")
    assert len(calls) == 2
    want = np.zeros(n)
    np.add.at(want, a, v * w[a] * w[b])
    np.add.at(want, b, v * w[a] * w[b])
    assert np.allclose(found, want)
    monkeypatch.setattr(BL, "_LEAST_ADDED", 10)
    assert np.allclose(BL._added(iter(batches[:7]), n, None, "_v").sum(), 2 * v[:700].sum())


def test_median_by_places_leaves_no_maps(spark):
    from statistics import median

    from weftmap.operators.ingest import aggregate_records

    nan = float("nan")
    rows = [(0, 0, 4.0, 7), (0, 0, 1.0, None), (0, 0, nan, 2), (0, 1, 3.0, 5), (0, 1, 9.0, 5), (0, 1, 2.0, 5), (1, 1, nan, None), (1, 1, None, None), (1, 2, 1.5, -3)]
    found = aggregate_records(spark.createDataFrame(rows, "bin1_id long, bin2_id long, x double, k int"), {"x": "median", "k": "median"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "percentile" not in plan
    want = {}
    for a, b, x, k in rows:
        xs, ks = want.setdefault((a, b), ([], []))
        xs += [] if x is None or x != x else [x]
        ks += [] if k is None else [k]
    assert {(r[0], r[1]): (r["x"], r["k"]) for r in found.collect()} == {p: tuple(median(v) if v else None for v in both) for p, both in want.items()}


def test_levels_of_a_pyramid_do_not_compute_the_bins_again(spark, monkeypatch):
    from weftmap.functions.bins import binnify, sequence_starts
    from weftmap.operators import reduce as R
    from weftmap.plans.genome import Genome

    bins = binnify(spark, Genome.of({"a": 90, "b": 34, "c": 7}), 2)
    asked = []
    monkeypatch.setattr(R, "sequence_starts", lambda b: asked.append(1) or sequence_starts(b))
    levels = R.zoom_levels(bins, pixels_of(spark, [(a, b, 1) for a in range(66) for b in range(a, 66, 5)]), tile=2)
    assert len(levels) > 4 and asked == [1]
    assert R.coarser_starts(sequence_starts(bins), 4) == sequence_starts(R.coarsen_bins(R.coarsen_bins(bins, 2), 2))
    for up in range(1, 4):
        bins_up, pixels_up = levels[max(levels) - up]
        ids = {r[0] for r in bins_up.select("bin_id").collect()}
        assert ids == set(range(len(ids))) and {r[0] for r in pixels_up.select("bin1_id").collect()} <= ids
        assert pixels_up.groupBy().sum("count").first()[0] == sum(len(range(a, 66, 5)) for a in range(66))
