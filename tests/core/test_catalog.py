"""Every registered query of the library itself against its SQL, on the smallest tables, where they are at hand."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from weftmap import catalog

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    found = catalog.queries()[name](spark, str(DATA))
    columns = sorted(found.columns)
    want = tables.execute(catalog.oracle_sql()[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == columns
    mine = sorted(tuple(str(plain(r[c])) for c in columns) for r in found.collect())
    theirs = sorted(tuple(str(plain(r[order.index(c)])) for c in columns) for r in want.fetchall())
    assert mine == theirs
