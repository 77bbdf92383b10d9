"""Connected components of a graph in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, hinted, settled


def few_edges(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges (a < b) with the components of ``edges``, about as few as there are nodes; and a bound of the nodes.

    Each node's smaller neighbours are tied to the least of them, and so is the node itself: of a node's many edges to
    leaders, one stays, and what ties the leaders to each other is the same for all that share them.
    """
    ends = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    n = ends.count()
    least = ends.groupBy("b").agg(F.min("a").alias("least"))
    between = ends.join(hinted(least, n), "b").where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return between.unionByName(least.select(F.col("least").alias("a"), "b")).distinct().checkpoint(), 2 * n


def connected_components(edges: DataFrame) -> tuple[DataFrame, int]:
    """``node`` and ``component`` (the least node it reaches) for every node of ``edges`` (a, b: bigint) with another one; and their number.

    A node takes the least label around it, and that label's label, so long chains take a logarithmic number of rounds.
    A round is two look-ups and a minimum by key, and is cut by a checkpoint; only whether anything changed comes to the
    driver. The table that is looked up has one row a node. It is broadcast if it is small; else both sides are shuffled
    for the join alone, so that adaptive execution can split the rows of a hub. Loops and repeated edges do no harm;
    rows with a null end are left out.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    ends, nodes = few_edges(edges.where("a IS NOT NULL AND b IS NOT NULL"))
    around = F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.col(y).alias("by")) for x in "ab" for y in "ab"]))
    near = ends.select(around.alias("x")).select("x.*").distinct().checkpoint()
    labels = near.groupBy("node").agg(F.min("by").alias("component")).checkpoint()
    while True:
        known = lambda name, label, table=labels: hinted(table.select(F.col("node").alias(name), F.col("component").alias(label)), nodes)
        least = near.join(known("by", "label"), "by").groupBy("node").agg(F.min("label").alias("near"), F.max(F.when(F.col("by") == F.col("node"), F.col("label"))).alias("old"))
        moved = least.join(known("near", "component"), "near").select("node", "old", "component").checkpoint()
        if moved.where("component < old").isEmpty():
            return settled(moved.select("node", "component"))
        labels = moved
