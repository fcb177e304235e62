"""Connected components over a table of links, by alternating large-star and
small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014). Every round is two aggregations and two joins; hub nodes are
pre-aggregated before the shuffle and the joins are left to adaptive skew
handling, so no node's neighbours are ever gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm.common import drop, written


def _least(edges: DataFrame) -> DataFrame:
    """(u, least of u and its neighbours) for edges (u, v)."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_least(both), "u").filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(spark: SparkSession, links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable from each linked node.
    Nodes without a link to another node do not appear. An empty table of
    links gives an empty table."""
    edges = written(spark, links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
                    .filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        nxt = written(spark, _small_star(_large_star(edges)), "stars")
        drop(spark, edges)
        edges = nxt
        # a sum in decimal: no overflow, and independent of the row order
        row = edges.agg(F.count(F.lit(1)).alias("n"),
                        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (row.n, row.h):
            break
        mark = (row.n, row.h)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
