"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), both long -> (node, root): the smallest node that each node reaches.

    In each round a node takes the least root among its own and its neighbours', then the root of that root, so labels
    travel along chains in doubling steps. Rounds end when no label changes.
    """
    pairs = edges.filter("a <> b").select("a", "b")
    both = store(pairs.union(pairs.select("b", "a")).distinct())
    label = store(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        near = both.join(label.withColumnsRenamed({"node": "b", "root": "seen"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        hooked = label.join(near, "node").select("node", "root", F.least("root", "seen").alias("next"))
        # A root follows what any of its members found, then everyone follows their root's root.
        found = hooked.groupBy("root").agg(F.min("next").alias("lower"))
        moved = store(hooked.join(found, "root").select("node", "root", F.least("next", "lower").alias("next")))
        step = moved.select(F.col("node").alias("at"), F.col("next").alias("beyond"))
        jumped = store(moved.join(step, moved["next"] == step["at"], "left").select("node", "root", F.least("next", F.coalesce("beyond", "next")).alias("next")))
        if jumped.filter("next <> root").isEmpty():
            return label
        label = jumped.select("node", F.col("next").alias("root"))
