"""Connected components of an edge table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the least node it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "large-star")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the least of them; edges have a > b."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "small-star")
    own = least.select("a", F.col("m").alias("b"))
    others = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.union(others).distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether every node has one label, which has none itself."""
    several = edges.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a")
    chained = edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").select("a")
    return several.union(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for the nodes of ``edges`` (longs ``a, b``): the least node reachable.

    Nodes that are their own label are left out. Each step is written, so neither lineage
    nor a node's number of edges builds up; steps are repeated until every node points to
    its label, which takes about the logarithm of a component's diameter.
    """
    held = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_done(held):
        held = stored(_small_star(_large_star(held)), "stars")
    return held.select(F.col("a").alias("node"), F.col("b").alias("label"))
