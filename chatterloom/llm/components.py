"""Connected components by alternating star contractions.

Each round hangs neighbours under the smallest node in reach; nodes and edges
stay in tables, nothing but a count and a checksum reaches the driver. Rounds
grow with the logarithm of the nodes. Groupings are pre-aggregated minima, so a
node with very many neighbours is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.session import written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with an edge (columns ``u, v``); root is the least node of its component.

    Self-loops and rows with a null are ignored; an edge may be repeated and point either way.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    now = written(edges.filter("u <> v").select(high.alias("u"), low.alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = written(_small_star(_large_star(now)), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    hung = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
