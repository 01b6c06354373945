"""Connected components of an edge table, by DataFrame operations alone."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import TRIM, trim


def _nearest(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, or itself where that is smaller."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge touches; component: the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes, which takes about the logarithm of the longest path.
    Smallest neighbours are taken by partial aggregation and joined back, so a node with very many edges is a skewed join
    that Spark may split, never one group in one task. Each round is checkpointed. Edges with a null end and loops count for
    nothing but their own nodes; no edges give no rows. Ends may be numbers or strings, of one type.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    stars = trim(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(stars)
    while before[0]:
        few = ceil(before[0] / TRIM)  # in one partition, a small graph needs no exchanges
        both = stars.union(stars.select("b", "a")).coalesce(few)
        near = trim(_nearest(both))
        large = both.where("b > a").join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = trim(large.union(near.select("a", F.col("m").alias("b"))).where("b <= a").coalesce(few).distinct())
        near = _nearest(large)
        small = large.join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = trim(small.union(near.select("a", F.col("m").alias("b"))).coalesce(few).distinct())
        now = _mark(stars)
        if now == before:
            break
        before = now
    return stars.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component"))


def _mark(stars: DataFrame) -> tuple:
    """Number and sum of hashes of edges: the same for the same edges."""
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
