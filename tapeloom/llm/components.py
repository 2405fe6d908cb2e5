"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so a node with very many edges is a skewed join key and
not a group in memory; nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.frames import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node that it reaches.

    Loops, repeated and reversed edges do no harm; edges with a null end are left out; no edges give
    no rows.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = stage(down.distinct())
    seen = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        state = stage(_small_star(_large_star(state)))
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(state.select(F.col("a").alias("node"), F.col("b").alias("root")))
