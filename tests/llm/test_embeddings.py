from __future__ import annotations

import numpy as np
from pyspark.sql import types as T

from weftmap.llm.embedding_dedup import calibrate, embedding_groups

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("e", T.LongType())])


def brute(rows, limit=0.9):
    n = len(rows)
    ok = [r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    v = [np.array(r[1], dtype=np.float32).astype(float) if o else None for r, o in zip(rows, ok)]
    link = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(v[i]) == len(v[j]):
                link[i, j] = v[i] @ v[j] / (np.linalg.norm(v[i]) * np.linalg.norm(v[j])) >= limit
    part = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in np.flatnonzero(link[i]):
                low = min(part[i], part[j])
                if part[i] != low or part[j] != low:
                    part[i] = part[j] = low
                    changed = True
    low = {k: min((r[0] for r, p in zip(rows, part) if p == k and r[0] is not None), default=None) for k in set(part)}
    return [(r[0], int(link[i].sum()), low[part[i]]) for i, r in enumerate(rows)]


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24))
    rows = [(i, x.tolist(), 0, "k", 1) for i, x in enumerate(base)]
    for i in range(60, 150):  # noise that puts many cosines about the limit
        x = base[i % 7] + rng.normal(size=24) * rng.choice([0.05, 0.3, 0.45, 0.6])
        rows.append((i, x.tolist(), 1, "k", 1))
    rows += [(200 + i, base[3].tolist(), None, None, None) for i in range(6)]
    rows += [(300, None, 0, "", 0), (301, [], 0, "", 0), (302, [0.0] * 24, 0, "", 0), (303, [None] * 24, 0, "", 0), (304, [float("nan")] * 24, 0, "", 0), (305, [float("inf")] + [1.0] * 23, 0, "", 0)]
    rows += [(310, [1.0], 0, "", 0), (311, [2.0], 0, "", 0), (312, [-1.0], 0, "", 0), (313, [1.0, 0.0], 0, "", 0), (314, [1.0, 0.1], 0, "", 0), (None, base[3].tolist(), 0, "", 0)]
    found = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert found == sorted(brute(rows), key=str)


def test_large_group_is_split_in_blocks(spark, monkeypatch):
    from weftmap.llm import _pairs

    monkeypatch.setattr(_pairs, "CAP", 20)
    rng = np.random.default_rng(2)
    center = rng.normal(size=16)
    rows = [(i, (center + 0.02 * rng.normal(size=16)).tolist(), 0, "", 0) for i in range(130)] + [(1000 + i, rng.normal(size=16).tolist(), 0, "", 0) for i in range(40)]
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == sorted(brute(rows))


def test_empty(spark):
    assert embedding_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_calibration():
    assert 2 <= calibrate(64, 0.9, 2) <= 32
