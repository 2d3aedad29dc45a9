from __future__ import annotations

import random

from weftmap.llm.components import connected_components


def brute(links):
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_random_graphs_chains_and_hubs(spark):
    rng = random.Random(3)
    hub = [(500, i) for i in range(501, 560)] + [(900, i) for i in range(840, 900)]
    chain = [(i, i + 1) for i in range(1000, 1060)]
    some = [(rng.randrange(200), 200 + rng.randrange(200)) for _ in range(180)]
    links = hub + chain + some + some[:10] + [(b, a) for a, b in some[:10]]
    rng.shuffle(links)
    found = connected_components(spark.createDataFrame(links, "u long, v long"))
    assert sorted((r.node, r.component) for r in found.collect()) == sorted(brute(links).items())


def test_no_links_nulls_and_loops(spark):
    rows = [(None, 1), (2, None), (3, 3)]
    assert connected_components(spark.createDataFrame(rows, "u long, v long")).collect() == []
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
