"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a long, b long): the smallest node it can reach.

    Each round points a node's larger neighbours, then its smaller ones, at its smallest; the
    number of rounds grows with the logarithm of the edges. Each round is written out, so lineage
    stays short and lost executors are no harm. Loops and repeated edges are no matter; rows with
    nulls are left out. No edges: no rows. A hub's edges are summed on each task before they move.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            seen = pairs.union(pairs.select("b", "a"))
        else:
            seen = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = seen.join(least, "a")
        if large:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = state(pairs)
    while before[0]:
        large = star(pairs, True).filter("a <> b").distinct()
        pairs = materialise(star(large, False).filter("a <> b").distinct(), "edges")
        after = state(pairs)
        if after == before:
            break
        before = after
    # All edges now join a node to its component's smallest.
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
