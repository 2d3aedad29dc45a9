"""Connected components of a link table, by alternating star contractions.

Each round replaces the links so that every node points to smaller ones, until all point to the smallest
of their component. Minima are pre-aggregated before the shuffle, and the links of a hub are spread over
several tasks where they meet what the hub is told. A round's links are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, release

#: More rounds than this have not been seen to be needed: their number grows as the logarithm of the nodes.
MAX_ROUNDS = 60


#: Shares into which a node's links are split when they meet what the node is told.
SHARES = 16


def _told(links: DataFrame, key: str, news: DataFrame) -> DataFrame:
    """Links with ``m`` of their node ``key`` from ``news`` (node, m), null where there is none. A hub's links are spread over SHARES tasks."""
    spread = links.withColumn("_s", F.pmod(F.xxhash64("u", "v"), F.lit(SHARES)))
    copies = news.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    return spread.join(copies, (F.col(key) == F.col("node")) & (F.col("_s") == F.col("_t")), "left").drop("_s", "_t", "node")


def _large_star(links: DataFrame) -> DataFrame:
    """Higher ends of each node's links go to the node's lowest neighbour, where that is lower than the node; ``links`` have u > v."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lower = both.groupBy("u").agg(F.min("v").alias("m")).where(F.col("m") < F.col("u")).select(F.col("u").alias("node"), "m")
    return _told(links, "v", lower).select("u", F.coalesce("m", "v").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Of each node's lower neighbours, the lowest takes the others and the node; ``links`` have u > v."""
    lowest = links.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("_top"))
    several = lowest.where(F.col("_top") > F.col("m")).select(F.col("u").alias("node"), "m")
    moved = _told(links, "u", several).where(F.col("m") < F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lowest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns u, v: long, u <> v): component is the smallest node reachable.

    Repeated and reversed links are allowed, links with a null or of a node to itself are ignored; no links give no rows.
    """
    own = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    now = materialize(own.distinct(), "links")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        then = materialize(_small_star(_large_star(now)), "links")
        release(now)
        now, before, state = then, state, _state(then)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(links: DataFrame) -> tuple[int, int]:
    """Enough to tell that a round changed nothing."""
    return tuple(links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
