"""Connected components by alternating stars, each round a shuffle of the edges alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), both long -> (node, root): the smallest node of each node's component. Only nodes with an edge to another appear.

    Large star: every neighbour above u moves to the least neighbour of u. Small star: every neighbour below u, and u, move
    there too. Both keep connectivity, and rounds grow with the logarithm of a component's size. Loops, repeats and nulls
    are left out; an empty table gives no rows.
    """
    now = store(_tidy(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))))
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = store(_tidy(large))
        small = _star(large)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = store(_tidy(small))
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == (None if last is None else tuple(last)):
            return _labels(now)


def _tidy(edges: DataFrame) -> DataFrame:
    """From the larger node to the smaller, once each."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(directed: DataFrame) -> DataFrame:
    """u, v, m: each edge with the least of its first node and that node's neighbours.

    The minima are stored, so that the join deals both sides out anew and a node with very many edges can be split."""
    least = store(directed.groupBy(F.col("a").alias("k")).agg(F.least(F.first("a"), F.min("b")).alias("m")))
    return directed.join(least, directed["a"] == least["k"]).select(F.col("a").alias("u"), F.col("b").alias("v"), "m")


def _labels(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
