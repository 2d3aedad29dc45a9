"""Pyramids of many levels."""

from __future__ import annotations

from collections import Counter

from weftmap.functions import bins as B
from weftmap.operators import reduce as R
from weftmap.plans.genome import Genome


def _leaves(frame) -> int:
    return frame._jdf.queryExecution().analyzed().collectLeaves().size()


def test_lazy_levels_grow_the_plan_by_a_step(spark, monkeypatch):
    bins = B.binnify(spark, Genome.of({"a": 640, "b": 630}), 10)
    cells = [(i, (i * 37) % 127, 1 + i % 3) for i in range(127)]
    cells = [(min(a, b), max(a, b), n) for a, b, n in cells]
    pixels = spark.createDataFrame(cells, "bin1_id long, bin2_id long, count long")
    coarser = lambda i, k: i // k if i < 64 else -(-64 // k) + (i - 64) // k
    levels = R.zoom_levels(bins, pixels, tile=4)
    deepest = max(levels)
    assert deepest == 5
    for level, (some, values) in levels.items():
        k = 2 ** (deepest - level)
        want = Counter()
        for a, b, n in cells:
            want[coarser(a, k), coarser(b, k)] += n
        assert {(r.bin1_id, r.bin2_id): r["count"] for r in values.collect()} == want
        assert some.count() == -(-64 // k) - (-63 // k) and _leaves(some) == _leaves(bins)
    monkeypatch.setattr(R, "MOST_PIECES", 0)
    by_joins = R.coarsen_bins(R.coarsen_bins(R.coarsen_bins(bins, 2), 2), 2)
    assert sorted(map(tuple, by_joins.collect())) == sorted(map(tuple, levels[deepest - 3][0].collect()))
    assert _leaves(by_joins) == _leaves(bins) + 3
