"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def is_star_forest(e: DataFrame) -> bool:
    """Whether every node ``u`` of edges (u, v), u > v, has one ``v``, which hangs on none."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    wrong = (ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
             .filter("up > 1 OR up = 1 AND down = 1"))
    return wrong.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the
    smallest node of its component. Each round hangs the neighbours of a node
    onto its smallest neighbour (larger ones, then smaller ones), until every
    edge points at a root, which one aggregation tells; rounds grow with the
    logarithm of the longest path, and a round is two aggregations and joins
    written to the shared folder."""
    spark = edges.sparkSession
    e = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
         .filter("u <> v").distinct())
    scratch = Scratch()
    e = scratch.keep(e, "components-edges")
    while not is_star_forest(e):
        # large star: every neighbour larger than u hangs on u's smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        # small star: u and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        nxt = Scratch()
        e = nxt.keep(small, "components-edges")
        scratch.free(spark)
        scratch = nxt
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return e.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
