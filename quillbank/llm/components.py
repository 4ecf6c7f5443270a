"""Connected components of a graph of links, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle

#: Rounds after which the input is taken to be faulty; each round at least halves what is left of a chain.
MOST_ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    """Large star, then small star: every node is tied to the least of its neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    # From here on u > v in every edge.
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(lowest, "u")
    small = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").union(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, component): the least node reachable, for nodes with a link.

    Alternating stars: the edges of a round replace those of the round before, which is
    written out each time. Null ends and loops are dropped; repeated links do no harm.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = settle(edges, "links")
    before = None
    for _ in range(MOST_ROUNDS):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        if not state[0]:
            break
        following = settle(_stars(edges), "links")
        discard(edges)
        edges = following
    else:
        raise RuntimeError("components did not settle")
    named = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return named.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
