"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklattice.session import materialise


def _star(both: DataFrame, small: bool) -> DataFrame:
    """Links each node's neighbours (of ``both``: node, other) to the smallest of them and itself.

    A large star moves the larger neighbours only; a small star, which sees smaller neighbours only, moves all and the node.
    """
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select(F.col("node").alias("center"), F.least("node", "least").alias("least"))
    joined = both.join(least, F.col("node") == F.col("center"))
    moved = joined if small else joined.filter("other > node")
    links = moved.select(F.col("other").alias("a"), F.col("least").alias("b"))
    if small:
        links = links.union(least.select(F.col("center").alias("a"), F.col("least").alias("b")))
    return links.filter("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether ``links`` (a, b), b the smaller, are stars: no a has two of them, and none is the b of another."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(links.select("b", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).filter("up > 1 or up = 1 and n > 1").isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): component is the smallest node that can be reached.

    Large-star and small-star steps take turns until the links are stars, which one grouping tells. They number in the order
    of the logarithm of the longest path; links that are stars already take none. A hub is a star already: its rows meet one row of minima, and Spark may split that join. Each round
    is written to the shared folder, so lost executors cost no more than their tasks. Links with a null end, and loops, are
    ignored; an empty table gives an empty one.
    """
    links = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for turn in range(max_rounds + 1):
        if _settled(links):
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        if turn < max_rounds:
            both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
            large = _star(both, False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
            small = _star(large.select(F.col("a").alias("node"), F.col("b").alias("other")), True)
            links = materialise(small, "links")
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
