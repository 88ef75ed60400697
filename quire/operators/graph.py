"""Reference graphs: resolution, closure and flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import checkpointed


def resolve(edges: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """Every edge (src, dst) with its object's columns; a reference without an object gives nulls."""
    return edges.join(objects, edges.dst == F.col(key), "left")


def reachable(edges: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """(root, node, depth): the closure of edges (src, dst) from roots (root), the least depth of each, up to ``limit`` steps.

    Nodes seen before are left out of the next step, so cycles end; a step is a join on the frontier alone.
    """
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, limit + 1):
        step = frontier.join(edges, frontier.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        fresh = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth))
        fresh = checkpointed(fresh)
        if not fresh.take(1):
            break
        seen = seen.unionByName(fresh)
        frontier = fresh
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (src, dst) is connected with.

    Nodes' neighbours are tied to the smallest of them, in rounds that each end in a checkpoint, until nothing changes; only minima are gathered by node.
    """
    now = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct()
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        outward = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = outward.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        inward = outward.join(nearest, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(inward.unionByName(nearest.select(F.col("w").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
        after = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if after == state:
            break
        state = after
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
