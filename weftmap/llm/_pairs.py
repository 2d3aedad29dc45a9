"""Comparing the members of many groups in bounded memory, without a row for each pair.

Groups over ``CAP`` rows are split into blocks; a group's rows then meet once for each pair of blocks, as
rows of their own, so that no task holds more than two blocks of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize

#: Rows of one block of a group.
CAP = 3000
#: Large groups up to this number (12 bytes each) are sent to every task.
FEW = 100_000
#: Pairs looked at in one go.
PAIRS_AT_ONCE = 2_000_000


def meet(rows: DataFrame, key: str, spread: str, *order: str) -> DataFrame:
    """Rows dealt and sorted by (key, _lo, _hi, _side, *order), with large keys split in blocks by a hash of ``spread``. ``rows`` are computed twice.

    ``_side`` is 0 for rows of the lower block and 1 for those of the higher; in the meeting of a block
    with itself (or of a key that is not split) all rows have 0.
    """
    large = rows.groupBy(key).count().where(F.col("count") > CAP).select(F.col(key).alias("_k"), F.ceil(F.col("count") / CAP).cast("int").alias("_n"))
    large = materialize(large, "large-groups")
    n_large = large.count()
    if not n_large:  # rows go straight to where they meet
        zero = F.lit(0)
        return rows.withColumns({"_lo": zero, "_hi": zero, "_side": zero}).repartition(key).sortWithinPartitions(key, *order)
    # Sent to every task while they are few, else joined where the rows are dealt by key.
    joined = rows.join(F.broadcast(large) if n_large <= FEW else large, rows[key] == large["_k"], "left").drop("_k")
    own = F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread, F.lit(7)), F.col("_n")).cast("int"))
    dealt = (
        joined.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1)))
        .withColumn("_lo", F.least("_own", "_other"))
        .withColumn("_hi", F.greatest("_own", "_other"))
        .withColumn("_side", F.when(F.col("_own") > F.col("_lo"), 1).otherwise(0))
        .drop("_n", "_own", "_other")
    )
    return dealt.repartition(key, "_lo", "_hi").sortWithinPartitions(key, "_lo", "_hi", "_side", *order)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups, with each row's first partner and number of partners in the table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        mark = _marks(batch, key)
        change = np.any(mark[1:] != mark[:-1], axis=1)
        if last is not None and (mark[0] != last).any():
            yield _partners(held, key)
            held = []
        edge = np.flatnonzero(change)
        if len(edge):
            held.append(batch.slice(0, edge[-1] + 1))
            yield _partners(held, key)
            held = [batch.slice(edge[-1] + 1)]
        else:
            held.append(batch)
        last = mark[-1]
    if held:
        yield _partners(held, key)


def _marks(batch: pa.RecordBatch | pa.Table, key: str) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in (key, "_lo", "_hi")], axis=1).astype(np.int64)


def _partners(held: list[pa.RecordBatch], key: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(held)
    mark = _marks(table, key)
    n = len(mark)
    new = np.concatenate([[0], np.flatnonzero(np.any(mark[1:] != mark[:-1], axis=1)) + 1, [n]]).astype(np.int64)
    group = np.repeat(np.arange(len(new) - 1), np.diff(new))
    side = table.column("_side").to_numpy().astype(np.int64)
    ones = np.bincount(group, weights=side, minlength=len(new) - 1).astype(np.int64)
    alone = (mark[:, 1] == mark[:, 2])  # a block with itself: later rows are partners
    at = np.arange(n)
    first = np.where(alone, at + 1, new[group + 1] - ones[group])
    count = np.where(alone, new[group + 1] - at - 1, np.where(side == 1, 0, ones[group]))
    return table, first, count


def windows(first: np.ndarray, count: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The partners of each row that lie within ``width`` of its own value; partners stand in the order of their values."""
    lo = _place(value, first, first + count, value - width)
    hi = _place(value, first, first + count, value + width + 1)
    return lo, hi - lo


def _place(value: np.ndarray, lo: np.ndarray, hi: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Where in its sorted range each target belongs, by binary search of all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    while len(on := np.flatnonzero(lo < hi)):
        middle = (lo[on] + hi[on]) // 2
        below = value[middle] < target[on]
        lo[on[below]], hi[on[~below]] = middle[below] + 1, middle[~below]
    return lo


def pairs(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays of all pairs (row, partner), a bounded number at once."""
    total = np.cumsum(count)
    lo = 0
    while lo < len(count):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, "right")))
        c = count[lo:hi]
        if c.sum():
            a = np.repeat(np.arange(lo, hi), c)
            b = np.repeat(first[lo:hi] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            yield a, b
        lo = hi


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between ids as links to the smallest id of each connected part, each id once."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (deeper := root[root]).tobytes() != root.tobytes():
            root = deeper
        if (root == before).all():
            break
    away = np.flatnonzero(root != np.arange(len(ids)))
    return ids[away], ids[root[away]]
