"""Connected components of an edge list by alternating large and small stars.

In a large star every node points its larger neighbours to the least node it sees, in a small star its
smaller ones; when nothing changes, each component is a star around its least node.  A hub's edges meet
one minimum, so its side of the join is split by adaptive execution, and minima are aggregated before the
shuffle.  Every second round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.llm.common import staged


def star(edges: DataFrame) -> DataFrame:
    """One large and one small star over ``u > v``."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.union(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


def mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the least node reachable) of every node with an edge to another."""
    x, y = F.col(a), F.col(b)
    now = staged(edges.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    was, is_ = None, mark(now)
    while is_ != was and is_[0]:
        now = staged(star(now), "stars")
        was, is_ = is_, mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
