"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _to_roots(hooks: DataFrame) -> DataFrame:
    """Follows parents to the roots by doubling: (node, root). Parents are smaller than their children: no cycles."""
    jumps = durable(hooks, "cc-hooks")
    while True:
        up = jumps.alias("x").join(jumps.alias("y"), F.col("x.root") == F.col("y.node"), "left")
        after = durable(up.select("x.node", F.coalesce("y.root", "x.root").alias("root"), F.col("y.root").isNotNull().alias("moved")), "cc-jump")
        moved = after.filter("moved").limit(1).count()
        jumps = after.select("node", "root")
        if not moved:
            return jumps


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of edges (a, b) reaches. Nodes without edges are not returned.

    Each round hooks every node to its least neighbour if that is smaller, contracts the trees and goes on with the
    distinct edges between their roots. A hot node is only ever one side of a join of written tables, which Spark
    splits, or a key of a partial aggregate. Every round is written: it survives lost executors. Edges to oneself,
    repeated edges and edges with nulls do no harm; no edges give an empty result.
    """
    ordered = lambda e: e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = durable(ordered(edges), "cc-edges")
    labels = durable(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node")), "cc-nodes")
    while left.limit(1).count():
        roots = _to_roots(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        labels = durable(
            labels.join(roots.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component")), "cc-labels"
        )
        moved = (
            left.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
            .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        )
        left = durable(ordered(moved), "cc-edges")
    return labels
