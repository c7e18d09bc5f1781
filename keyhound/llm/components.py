"""Connected components of a table of edges, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large(edges: DataFrame) -> DataFrame:
    """Each node hands the least of its neighbours and itself to its larger neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node hands the least of its smaller neighbours to the others and to itself; u > v in edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    handed = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: for each node of edges (u, v bigint) the least node that it is connected with.

    Every round is a few joins and sums before the shuffle, and ends in a checkpoint; the number of rounds grows
    with the logarithm of the longest chain. Nothing is gathered by component.
    """
    e = edges.where(F.col("u") != F.col("v"))
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    while before[0]:
        e = cut(_small(_large(e).where(F.col("u") != F.col("v")).distinct()).distinct())
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
