"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combining and two equi-joins. The smallest
partners are written before they are joined: a join next to the aggregation it reads from would
share its shuffle, which Spark never splits. As it is, both sides of a join are shuffles of their
own, and AQE splits the partition of a hub that touches a third of all nodes, or broadcasts the
side that is small. The number of rounds grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize


def _minima(pairs: DataFrame) -> DataFrame:
    """Smallest partner of each ``u``, or ``u`` itself where that is smaller."""
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m")), "minima")


def _round(edges: DataFrame) -> DataFrame:
    """The edges after a large-star and a small-star step; files of the round are deleted."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    up, least = both.filter("v > u"), _minima(both)
    large = materialize(
        up.join(least, F.col("u") == F.col("mu")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(),
        "large-star",
    )
    low = _minima(large)
    moved = (
        large.join(low, F.col("u") == F.col("mu"))
        .filter("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    kept = low.select(F.col("mu").alias("u"), F.col("m").alias("v"))
    out = materialize(moved.unionByName(kept).distinct(), "stars")
    for done in (edges, least, large, low):
        discard(done)
    return out


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` for every node that occurs in a link between different nodes.

    ``component`` is the smallest node reachable. Links with a null end or between a node and
    itself are ignored; repeated links and either direction count once; no links give an empty
    table. Nodes are longs.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = materialize(
        links.filter(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
        .distinct(),
        "links",
    )
    state = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == state or now[0] == 0:
            break
        state = tuple(now)
        edges = _round(edges)
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(centres)
