"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import Scratch, settled


def _stars(edges: DataFrame, settled, *, large: bool) -> DataFrame:
    """One contraction: neighbours of each node are hung on its smallest neighbour.

    Minima are taken before the shuffle and joined back, so that the hub of a large
    component is no single group; the join may be split by its skew."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges  # u > v
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = settled(least.select("u", F.least("u", "m").alias("m")))
    hung = both.join(least, "u")
    if large:
        new = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return new.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none."""
    sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    each = sides.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return each.where("hangs > 1 or (hangs > 0 and holds > 0)").isEmpty()


def components(links: DataFrame, scratch: Scratch | None = None, *, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node reachable.

    Nodes are of any ordered type.  Self-links, repeated links and links with a null are
    ignored.  Intermediate tables, which the result reads, go to ``scratch`` where it is given.
    The number of rounds grows with the logarithm of the longest chain."""
    keep = scratch.settled if scratch else settled
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = keep(edges)
    for _ in range(max_rounds):
        if _is_settled(edges):
            break
        edges = keep(_stars(_stars(edges, keep, large=True), keep, large=False).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
