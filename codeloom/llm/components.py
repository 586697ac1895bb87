"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import fingerprint, staged


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(fingerprint("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the least node reachable.

    Each round hangs nodes under smaller ones: first every node's greater neighbours under
    its least neighbour, then its lesser ones. The number of rounds grows with the
    logarithm of the longest path. Every round is written to the shared folder; the
    minima are written too, so that a node with very many links is split in the join.
    Links of a node with itself or with null add nothing.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = _signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "minima")
        large = staged(both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        lesser = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(lesser.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _signature(edges)
        if after == before:
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        before = after
