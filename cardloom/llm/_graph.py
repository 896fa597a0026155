"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import stored


def _lowest(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the smallest neighbour of u or u itself. The minimum is combined before the shuffle;
    a node with very many edges makes a skewed join, which AQE splits."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(low, "u")


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) for each node of `edges` (u, v); component is the smallest node reachable.

    Null ends are left out; self loops and repeated edges don't matter; no edges give no rows. Each round is written to
    the shared folder, and nothing but two numbers a round comes to the driver.
    """
    edges = edges.where("u is not null and v is not null")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        ends = _lowest(large)
        pairs = ends.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = stored(pairs.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
