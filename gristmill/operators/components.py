"""Connected components by alternating large and small stars (Kiveris et al.), for the duplicate graph of the preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.plans.shared import Scratch


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the least of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    stars = down.join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b")
    return stars.unionAll(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def least_labels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b of one ordered type): label is the least node of its component.

    Each round is a job over a table of the round before, kept in the shared folder; the number of rounds grows with the logarithm
    of the component size. A node with very many neighbours splits in the joins, and its minimum combines before the shuffle.
    """
    current = scratch.keep(edges.select("a", "b").where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        following = scratch.keep(_small(_large(current)), "stars")
        seen = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(current)
        current = following
        if seen == state:
            break
        state = seen
    nodes = current.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return nodes.unionAll(current.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
