"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round. ``edges``: (u, v), u > v. The least neighbour of a hub is found by partial
    aggregation and joined back, so a hub's edges need not meet in one task."""
    around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    met = around.join(least, F.col("u") == F.col("_u"))
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the least node reachable.

    Loops and repeated edges do no harm; no edges give no rows. Rounds grow with
    the logarithm of the longest path; each ends in a checkpoint, and only a
    count and a sum of hashes reach the driver.
    """
    current = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = None
    for _ in range(max_rounds):
        now = current.select(mark).head()[0]
        if now == before or now[0] == 0:
            break
        before = now
        current = cut(_stars(_stars(current, large=True), large=False))
    else:
        raise RuntimeError("connected components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
