"""Packing documents into fixed windows by non-negative least squares over window fillings.

Every document is cut into pieces of the window's length and a remainder. The remainders' lengths form a
histogram of at most ``window`` counts, which alone decides the plan:

1. shallow combinations of lengths that fill a window exactly are enumerated;
2. non-negative least squares finds how often each is to be used to reproduce the histogram;
3. the counts are rounded, never beyond what is there, and the rest is solved again a few times;
4. what remains is packed greedily, longest first, the longest that still fits next.

The plan's size depends on the window, not on the corpus. Pieces are then dealt to the plan's slots by
their rank among the pieces of their length; ranks come from counts per task, so no length is gathered
in one place.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._batches import slices, texts_of
from ._store import materialize
from ._tokens import encoder

WINDOW = 1024
#: Combinations of three and four lengths are enumerated on a grid with about this many points a side.
GRID = 48
ROUNDS = 4

_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, rank long"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"

#: A plan: (lengths with how often each stands in the window, number of such windows).
Plan = list[tuple[list[tuple[int, int]], int]]


def fillings(hist: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to four lengths, present in the histogram, that add up to the window; zero for none."""
    have = np.flatnonzero(hist)
    have = have[have < window]
    if not len(have):
        return np.zeros((0, 4), dtype=np.int64)
    some = have[np.unique(np.linspace(0, len(have) - 1, GRID).astype(int))]
    ok = np.zeros(window + 1, dtype=bool)
    ok[have] = True
    rows = [np.stack([have, window - have, 0 * have, 0 * have], 1)]
    a, b = (x.ravel() for x in np.meshgrid(have, some))
    rows.append(np.stack([a, b, window - a - b, 0 * a], 1))
    a, b, c = (x.ravel() for x in np.meshgrid(some, some, some[:: max(1, len(some) // 16)]))
    rows.append(np.stack([a, b, c, window - a - b - c], 1))
    rows[0] = rows[0][ok[rows[0][:, 1]]]
    rows[1] = rows[1][(rows[1][:, 2] > 0)]
    rows[1] = rows[1][ok[rows[1][:, 2]]]
    rows[2] = rows[2][(rows[2][:, 3] > 0)]
    rows[2] = rows[2][ok[rows[2][:, 3]]]
    return np.unique(np.sort(np.concatenate(rows), axis=1)[:, ::-1], axis=0)


def nonnegative_least_squares(rows: np.ndarray, hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that nearly minimises |A x - hist|, where column j of A counts the lengths of rows[j]; accelerated projected gradient."""
    n = len(hist)

    def forward(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(rows[:, k], weights=x, minlength=n) for k in range(rows.shape[1]))
        out[0] = 0
        return out

    def backward(r: np.ndarray) -> np.ndarray:
        return sum(r[rows[:, k]] for k in range(rows.shape[1]))

    v = np.ones(len(rows))
    for _ in range(12):  # the largest eigenvalue of A'A
        v = backward(forward(v))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(len(rows))
    h, t = hist.astype(float), 1.0
    h[0] = 0
    for _ in range(steps):
        r = forward(y) - h
        r[0] = 0
        step = np.maximum(0, y - backward(r) / (size * 1.05))
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = step + (t - 1) / t_next * (step - x)
        x, t = step, t_next
    return x


def plan_windows(hist: np.ndarray, window: int = WINDOW) -> Plan:
    """How to pack ``hist[n]`` pieces of each length n into windows."""
    left, plan = hist.astype(np.int64).copy(), []
    if left[window]:
        plan.append(([(window, 1)], int(left[window])))
        left[window] = 0
    for _ in range(ROUNDS):
        rows = fillings(left, window)
        if not len(rows):
            break
        x = nonnegative_least_squares(rows, left)
        used = 0
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            need = Counter(int(n) for n in rows[j] if n)
            times = min([int(round(x[j])), *(int(left[n]) // k for n, k in need.items())])
            if times > 0:
                plan.append((sorted(need.items(), reverse=True), times))
                used += times
                for n, k in need.items():
                    left[n] -= k * times
        if not used:
            break
    while left.any():  # greedily, as many windows of one kind at once as the counts allow
        room, need, have = window, [], np.flatnonzero(left)
        while len(have) and room:
            at = int(np.searchsorted(have, room, "right")) - 1
            if at < 0:
                break
            n = int(have[at])
            k = min(room // n, int(left[n]))
            need.append((n, k))
            room -= k * n
            have = have[:at]
        times = min(int(left[n]) // k for n, k in need)
        plan.append((need, times))
        for n, k in need:
            left[n] -= k * times
    return plan


def _slots(plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, the first ranks of its slots : first sequence, offset, how many in a window, total of the window."""
    by: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequence = 0
    taken: Counter = Counter()
    for need, times in plan:
        at, total = 0, sum(n * k for n, k in need)
        for n, k in need:
            by.setdefault(n, []).append((taken[n], sequence, at, k, total))
            taken[n] += k * times
            at += n * k
        sequence += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for n, rows in by.items()}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``window`` tokens.

    A document's tokens are its ids and ``end_id``; a null or empty text has the end id alone. Each token lies
    in exactly one piece; in a sequence pieces follow each other without gaps from offset 0. A sequence is
    padded to ``padded_length``: its own length where that is a power of two, else the window. Rows with the
    same or a null id are packed each for itself; other columns are ignored; an empty table gives no row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen: Counter = Counter()
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for piece in slices(batch, "t"):
                out = []
                for doc_id, ids in zip(piece.column(0).to_pylist(), enc.encode(texts_of(piece, "t"))):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        size = min(window, n - start)
                        out.append((doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, part, seen[size]))
                        seen[size] += 1
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])

    pieces = materialize(rows.mapInArrow(cut, _PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    hist = np.zeros(window + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
        hist[r.length] = r.n
    slots = _slots(plan_windows(hist, window))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy() + batch.column("first").to_numpy()
            sequence, offset, total = (np.zeros(len(length), dtype=np.int64) for _ in range(3))
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first, base, at, times, size = slots[int(n)]
                slot = np.searchsorted(first, rank[own], "right") - 1
                k = rank[own] - first[slot]
                sequence[own] = base[slot] + k // times[slot]
                offset[own] = at[slot] + k % times[slot] * n
                total[own] = size[slot]
            padded = np.where(total & (total - 1), window, total)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(length), batch.column("ids_crc32"), batch.column("doc_tokens"), pa.array(sequence), pa.array(offset), pa.array(padded)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"],
            )

    return pieces.join(firsts, ["part", "length"]).mapInArrow(place, _PLACED)
