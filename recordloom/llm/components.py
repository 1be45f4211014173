"""Connected components of a graph of integer nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import counted, few_tasks


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the component's least node) for each node of `edges` (a, b) but the roots themselves.

    Each round is written to the shared folder, so the lineage stays short. A star's joins are by its centre, whose
    rows Spark may split; minima are aggregated before they are shuffled. The rounds grow with the logarithm of the
    longest chain.
    """
    tidy = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    # the write of a round tells whether it has changed anything
    written = lambda df: counted(df, "edges", F.bit_xor(F.xxhash64("a", "b")))
    edges, before = written(tidy(edges))
    while before[0]:
        edges, now = written(few_tasks(tidy(_small_star(tidy(_large_star(edges)))), before[0]))
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
