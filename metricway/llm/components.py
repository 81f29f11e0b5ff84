"""Connected components of links, as a distributed union-find: alternating star contractions.

Each round points every node at the least node it knows, once over all its neighbours and once over the smaller ones,
until every node points at the least of its component. A node's least neighbour is a partial aggregate and goes back to the
links by a join that Spark can split, so a hub with a third of all links is no single task. Every round is a written
table in the shared folder: nothing is recomputed when an executor is lost, and nothing but whether
a node is left to move reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricway.llm.common import released, written


def _settled(links: DataFrame) -> bool:
    """Whether every node points at one root and no root points on: then a further round would change nothing."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("points")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("points")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.points").alias("out"), F.min("e.points").alias("target"))
    return nodes.filter("out > 1 OR (out = 1 AND target = 0)").head() is None


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("least"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b), longs; the component is its least node.

    Self-links, repeated links and either direction are allowed; no links give no rows.
    """
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while not _settled(now):
        large = written(_large_star(now).filter("a <> b").distinct())
        before, now = now, written(_small_star(large).filter("a <> b").distinct())
        released(before, large)
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
