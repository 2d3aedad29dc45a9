"""Planning on the driver: resolutions, predecessors and interval partitions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import numpy as np


def partition(start: int, stop: int, step: int) -> list[tuple[int, int]]:
    """Consecutive intervals of ``step``, the last possibly shorter."""
    return [(i, min(i + step, stop)) for i in range(start, stop, step)]


def preferred_sequence(start: int, stop: int, style: str = "nice") -> list[int]:
    """Resolutions from ``start`` to at most ``stop``: doubling (``binary``), or times 2, 5 and 10, then the same from ten times on (``nice``);
    a start with the leading digit 5 goes on by 10 and 25, ones with 2 by 4 and 10: 5, 10, 25, 50 and 2, 4, 10, 20."""
    if style not in ("binary", "nice"):
        raise ValueError(f"unknown style: {style}")
    out, base = [], start
    while base <= stop:
        multiples = (1,) if style == "binary" else (1, 2, 5)
        out += [base * m for m in multiples if base * m <= stop]
        base *= 2 if style == "binary" else 10
    return out


def standard_sequence(stop: int) -> list[int]:
    """The usual resolutions of public contact maps: 1000, 2000, and from 5000 to ``stop``."""
    return [1000, 2000, *preferred_sequence(5000, stop)]


def parse_resolutions(spec: str, base: int, stop: int) -> list[int]:
    """``1000,2000``, ``B``/``N`` (sequences from the base), ``1000N``/``4000B`` (sequences from there), or ``4DN``."""
    out: list[int] = []
    for token in (t.strip() for t in spec.split(",") if t.strip()):
        if token.upper() == "4DN":
            out += standard_sequence(stop)
        elif token[-1] in "bBnN":
            first = int(token[:-1]) if token[:-1] else base
            out += preferred_sequence(first, stop, "binary" if token[-1] in "bB" else "nice")
        else:
            out.append(int(token))
    return sorted(set(out))


def predecessors(bases: Sequence[int], targets: Sequence[int]) -> list[tuple[int, int | None, int]]:
    """(resolution, the one it is made from, factor) in making order. A base comes from nothing; every other one from the
    largest smaller resolution that divides it."""
    wanted = sorted({*bases, *targets})
    out = []
    for r in wanted:
        if r in set(bases):
            out.append((r, None, 1))
            continue
        below = [s for s in wanted if s < r and r % s == 0]
        if not below:
            raise ValueError(f"no resolution divides {r}")
        out.append((r, below[-1], r // below[-1]))
    return out


def quad_tile_depth(total: int, binsize: int, tile: int = 256) -> int:
    """Doublings until the whole genome fits in one tile."""
    tiles = -(-total // (tile * binsize))
    return max(0, int(tiles - 1).bit_length())


def merge_breakpoints(indexes: Sequence[Sequence[int]], bufsize: int) -> tuple[np.ndarray, np.ndarray]:
    """Row ranges over which the tables behind the offset arrays hold at most ``bufsize`` records together (or one row), and
    the records before each edge."""
    total = np.sum(np.stack([np.asarray(i, dtype=np.int64) for i in indexes]), axis=0)
    edges = [0]
    while edges[-1] < len(total) - 1:
        reach = int(np.searchsorted(total, total[edges[-1]] + bufsize, "right")) - 1
        edges.append(max(edges[-1] + 1, reach))
    return np.array(edges), total[edges]


def balanced_partition(lengths: Sequence[int], n: int) -> list[tuple[int, int, int]]:
    """(sequence, start, end) intervals that cut the concatenated sequences in about n equal shares, none over a boundary."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    cuts = np.unique(np.concatenate([offsets, np.linspace(0, offsets[-1], n + 1).astype(np.int64)]))
    seq = np.searchsorted(offsets, cuts[:-1], "right") - 1
    return [(int(s), int(a - offsets[s]), int(b - offsets[s])) for s, (a, b) in zip(seq, pairwise(cuts))]
