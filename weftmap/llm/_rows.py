"""Acting on rows rather than on their ids, and joins in which some keys hold many rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of more rows than this are joined by broadcast: they are at most one in this number of the rows.
HOT_ROWS = 100_000
#: Row numbers sent to every task at most, 16 bytes each; more are joined by a shuffle.
SENT_ROWS = 2_000_000


def fresh_name(columns: Sequence[str], stem: str) -> str:
    """A column name that is not taken, whatever the case."""
    taken, name = {c.lower() for c in columns}, f"_{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def by_position(docs: DataFrame, run: Callable[..., DataFrame], *columns: str) -> DataFrame:
    """``run`` on the rows with columns named c0, c1 and so on, and the new names of ``columns``; its result gets the old names again.
    So columns may have any names, which functions on Arrow batches could not take otherwise."""
    names = docs.columns
    return run(docs.toDF(*(f"c{i}" for i in range(len(names)))), *(f"c{names.index(c)}" for c in columns)).toDF(*names)


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str, hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for every key, with the number of ``rows`` that hold it in ``weight``.

    The few keys of over ``hot`` rows go to every task, so that their rows stay where they are; the others meet by a shuffle.
    """
    big, small = table.where(F.col(weight) > hot).drop(weight), table.where(F.col(weight) <= hot).drop(weight)
    rest = rows.join(F.broadcast(big.select(key)), key, "left_anti")
    return rows.join(F.broadcast(big), key).unionByName(rest.join(small, key))


def without_rows(stored: DataFrame, number: str, gone: DataFrame) -> DataFrame:
    """``stored`` without the rows whose ``number`` stands in ``gone`` (one column), and without the number."""
    (column,) = gone.columns
    name = fresh_name(stored.columns, "gone")
    gone = gone.select(F.col(column).alias(name))
    gone = F.broadcast(gone) if gone.limit(SENT_ROWS + 1).count() <= SENT_ROWS else gone
    return stored.join(gone, F.col(number) == F.col(name), "left_anti").drop(number)
