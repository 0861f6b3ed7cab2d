"""Connected components of a graph given as a table of edges, by alternating large-star and
small-star rounds; nothing of the graph comes to the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = stash(edges.select("u", "v").union(edges.select("v", "u")))
    least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return stash(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), [both, least])


def _small_star(edges: DataFrame, old: DataFrame) -> DataFrame:
    least = stash(edges.groupBy("u").agg(F.min("v").alias("m")), [old])
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stash(moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), [edges, least])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: (u, v), any orientation, u <> v. Returns (u, v): each node that isn't the least of its
    component, with the least. Nodes without an edge are absent. A round's tables are deleted when the next one stands."""
    edges = stash(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    digest = None
    for _ in range(most_rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not now[0] or now == digest:
            return edges
        digest = now
        edges = _small_star(_large_star(edges), edges)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
