"""Connected components of a link table by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them; here ``a`` is the smaller end."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b")
    return tied.select(F.col("m").alias("a"), F.col("a").alias("x")).where("a <> x").union(least.select(F.col("m"), F.col("b"))).select(F.col("a"), F.col("x").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (its least member) for every node of the links ``a``, ``b`` (longs).

    Self links count as nodes of their own; repeated and reversed links do no
    harm; links with a null end are no links; an empty table gives an empty
    result.  Rounds grow with the logarithm of the longest path; each is written
    to the shared folder, so a lost executor repeats one round at most.
    """
    known = edges.where("a is not null and b is not null")
    current = staged(known.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    alone = known.where("a = b").select(F.col("a").alias("id"))
    state = None
    while True:
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        current = staged(_small_star(_large_star(current)), "links")
    tied = current.select(F.col("b").alias("id"), F.col("a").alias("component")).union(current.select(F.col("a"), F.col("a")).distinct())
    return tied.union(alone.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
