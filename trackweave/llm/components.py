"""Connected components of a graph given as pairs of node numbers, by alternating star contraction.

A large-star step points every node's larger neighbours at its least neighbour, a small-star step
points a node and its smaller neighbours at the least of them; the two in turn leave every component a
star around its least node after about log(n) rounds. A step is one aggregation and one join, each
round is a table in the shared folder, and nothing of the graph reaches the driver but two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm import store


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node it reaches) of every node of the pairs (a, b); a table of the store.

    Repeated pairs, loops and either order are fine; pairs with a null are ignored. A node with loops
    only comes out as its own component.
    """
    pairs = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    edges = store.written(_turned(pairs).distinct(), "edges", few=True)
    before = None
    while True:
        after = store.written(_small_star(_large_star(edges)), "edges", few=True)
        store.drop(edges)
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        edges = after
        if now == before:
            break
        before = now
    nodes = links.select(F.explode(F.array(F.col("a").cast("long"), F.col("b").cast("long"))).alias("node")).dropna().distinct()
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    named = store.written(nodes.join(found, "node", "left").select("node", F.least("node", F.coalesce("component", "node")).alias("component")), "found", few=True)
    store.drop(edges)
    return named


def _turned(pairs: DataFrame) -> DataFrame:
    """Each pair once, larger node first; loops go."""
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
    out = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _turned(out).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    moved = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return _turned(moved.unionByName(own)).distinct()
