from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from weftmap.plans.genome import Genome
from weftmap.plans.regions import natural_sorted, parse_number, parse_region, parse_region_text, parse_uri
from weftmap.plans.resolutions import balanced_partition, merge_breakpoints, parse_resolutions, partition, predecessors, preferred_sequence, quad_tile_depth


@pytest.mark.parametrize(
    ("text", "expected"),
    [("c1", ("c1", None, None)), ("c1:1,000-2,000", ("c1", 1000, 2000)), ("c1:1k-2M", ("c1", 1000, 2_000_000)), ("c1:1.5kb-", ("c1", 1500, None)), ("a|b-c.d:0-5", ("a|b-c.d", 0, 5)), ("c1:5-5", ("c1", 5, 5))],
)
def test_region_text(text, expected):
    assert parse_region_text(text) == expected


@pytest.mark.parametrize("text", ["", ":1-2", "c1:", "c1:5", "c1:-5", "c1:9-5", "c1:a-b", "c1:1-2-3", "c 1:1-2", "c1:1.0x-2"])
def test_bad_region_text(text):
    with pytest.raises(ValueError):
        parse_region_text(text)


def test_regions_against_sizes():
    sizes = {"a": 100, "b": 50}
    assert parse_region("a", sizes) == ("a", 0, 100)
    assert parse_region(("b", 10, None), sizes) == ("b", 10, 50)
    assert parse_region("a:10-", sizes) == ("a", 10, 100)
    for bad in ("c", "a:5-101", ("a", -1, 5), ("a", 7, 3)):
        with pytest.raises(ValueError):
            parse_region(bad, sizes)
    with pytest.raises(ValueError):
        parse_region("a")


def test_small_parsers():
    assert [parse_number(x) for x in ("7", "1,234", "2k", "1.5Mb", "3G")] == [7, 1234, 2000, 1_500_000, 3_000_000_000]
    assert parse_uri("x/y") == ("x/y", "/") and parse_uri("x::g/h") == ("x", "/g/h") and parse_uri("x::/") == ("x", "/")
    with pytest.raises(ValueError):
        parse_uri("a::b::c")
    assert natural_sorted(["c10", "c2", "c1", "x"]) == ["c1", "c2", "c10", "x"]


def test_sequences_and_predecessors():
    assert preferred_sequence(1000, 50_000, "nice") == [1000, 2000, 5000, 10_000, 20_000, 50_000]
    assert preferred_sequence(1, 100) == [1, 2, 5, 10, 20, 50, 100] and preferred_sequence(5, 100) == [5, 10, 25, 50, 100]
    assert preferred_sequence(2000, 20_000, "nice") == [2000, 4000, 10_000, 20_000]
    assert preferred_sequence(3, 50, "binary") == [3, 6, 12, 24, 48]
    assert preferred_sequence(10, 5) == []
    with pytest.raises(ValueError):
        preferred_sequence(1, 9, "other")
    assert parse_resolutions("B", 1000, 5000) == [1000, 2000, 4000]
    assert parse_resolutions("500,2000N", 1000, 10_000) == [500, 2000, 4000, 10_000]
    assert parse_resolutions("4DN", 1000, 60_000) == [1000, 2000, 5000, 10_000, 25_000, 50_000]
    assert parse_resolutions("4000B", 1000, 9000) == [4000, 8000]
    assert predecessors([2], [4, 6, 12]) == [(2, None, 1), (4, 2, 2), (6, 2, 3), (12, 6, 2)]
    assert predecessors([2, 4], [8]) == [(2, None, 1), (4, None, 1), (8, 4, 2)]
    with pytest.raises(ValueError):
        predecessors([2], [7])
    assert quad_tile_depth(256, 1) == 0 and quad_tile_depth(257, 1) == 1 and quad_tile_depth(1024 * 10, 10) == 2
    assert partition(0, 7, 3) == [(0, 3), (3, 6), (6, 7)]


@given(st.lists(st.lists(st.integers(0, 20), min_size=5, max_size=5), min_size=1, max_size=4), st.integers(1, 60))
def test_breakpoints_bound_every_epoch(counts, bufsize):
    indexes = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
    edges, before = merge_breakpoints(indexes, bufsize)
    total = np.sum(indexes, axis=0)
    assert edges[0] == 0 and edges[-1] == 5 and (np.diff(edges) > 0).all() and (before == total[edges]).all()
    for lo, hi in zip(edges, edges[1:]):
        assert total[hi] - total[lo] <= bufsize or hi == lo + 1


@given(st.lists(st.integers(1, 50), min_size=1, max_size=5), st.integers(1, 9))
def test_balanced_partition_covers(lengths, n):
    covered = [0] * len(lengths)
    for s, lo, hi in balanced_partition(lengths, n):
        assert covered[s] == lo < hi
        covered[s] = hi
    assert covered == lengths


def test_fixed_extents():
    g = Genome.of({"a": 25, "b": 20, "c": 3})
    assert g.fixed_offsets(10) == [0, 3, 5, 6]
    assert g.fixed_extent("a", 10) == (0, 3) and g.fixed_extent("b:9-11", 10) == (3, 5) and g.fixed_extent("c", 10) == (5, 6)
