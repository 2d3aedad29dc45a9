"""As many families as the promised share of pairs needs, and keys with room for them."""

from __future__ import annotations

import numpy as np
import pytest


def test_families_grow_until_few_pairs_are_missed(monkeypatch):
    from weftmap.llm import embedding_dedup

    assert embedding_dedup.calibrate(384, 0.9, 3) > 64
    monkeypatch.setattr(embedding_dedup, "MAX_FAMILIES", 20)
    with pytest.raises(ValueError):
        embedding_dedup.calibrate(64, 0.9, 3, 1000)


def test_keys_are_told_apart():
    from weftmap.llm.embedding_dedup import MAX_FAMILIES, _arity, _key_parts, _keys

    seen = set()
    for dim in (1, 4, 64, 768, 5160, 8191, 8192, 131_071):
        last = (2 * max(4, dim)) ** _arity(10**12, dim) - 1
        for family in (0, 64, MAX_FAMILIES - 1):
            key = _keys(dim, family, np.array([0, 1, last]))
            assert [x.tolist() for x in _key_parts(key)] == [[family] * 3, [0, 1, last]]
            seen.update(key.tolist())
    assert len(seen) == 8 * 3 * 3


@pytest.mark.parametrize("dim, arity", [(64, 2), (64, 3), (16, 2)])
def test_pairs_at_the_limit_are_met(dim, arity):
    from weftmap.llm import embedding_dedup as E

    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + (1 - 0.81) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    met = np.zeros(len(x), dtype=int)
    for r in E._rotations(dim, E.calibrate(dim, 0.9, arity), arity):
        met += E._met(E._coded(*E._taken(x, r)), E._coded(*E._taken(y, r)), E.window_of(dim, 0.9)).any((1, 2))
    assert (met < E.COUNT).sum() <= 3


def test_windows_are_swept():
    from weftmap.llm._pairs import windows

    rng = np.random.default_rng(2)
    value = np.sort(rng.integers(0, 100, 60))
    first, count = np.arange(60) + 1, 59 - np.arange(60)
    lo, n = windows(first, count, value, 7)
    assert [sorted(range(a, a + k)) for a, k in zip(lo, n)] == [[j for j in range(i + 1, 60) if abs(value[j] - value[i]) <= 7] for i in range(60)]


def test_very_large_and_small_components(spark):
    from weftmap.llm.embedding_dedup import embedding_groups

    rows = [(i, [s * a, s * b, s * c]) for i, (s, a, b, c) in enumerate([(1e200, 1.0, 2.0, 3.0), (1e200, 1.0, 2.0, 3.1), (1e-200, 1.0, 2.0, 3.0), (1.0, -3.0, 1.0, 0.0)])]
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert found == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 0, 3)]
