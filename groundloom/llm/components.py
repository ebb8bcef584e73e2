"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundloom.lineage import released
from groundloom.llm.common import cut


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. edges: a > b, no repeats.

    Least neighbours come from a sum with map-side combine and are joined back
    on a unique key, so a node with very many neighbours is split like any
    skewed join and never gathered.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where(F.col("a") != F.col("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a")
    moved = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of edges (a, b) but the roots, the smallest node it reaches.

    Lineage is cut by a checkpoint each round; rounds grow with the logarithm
    of the longest chain. An empty table gives no rows.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    state = None
    while True:
        with released(now.sparkSession):
            mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == state or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = mark
        now = cut(_round(now))
