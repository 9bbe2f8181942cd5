"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.lineage import cut


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it can reach) of every node of links(a, b).

    Each round maps a node to its smallest neighbour or itself and replaces the
    links by those between images; links never leave the executors, and a round's
    tables are written, so that lineage stays short. For nodes in random order (such as digests) the rounds
    grow as the logarithm of the longest path.
    """
    edges = cut(links.select("a", "b").where("a <> b").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "step")
        if roots is None:
            roots = step.withColumnRenamed("to", "root")
        else:
            moved = step.select(F.col("node").alias("root"), "to")
            roots = cut(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        x, y = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = cut(edges.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
