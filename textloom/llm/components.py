"""Connected components of a graph given by edges, all of it in Spark.

Alternates the large-star and small-star steps (Kiveris et al., 2014) until the edges
no longer change; then every node points at the smallest node of its component.  The
minimum of each node's neighbours is a partial aggregate, and the join that carries it
back is a plain shuffled join, so a node with very many neighbours is summed before the
shuffle and split by adaptive execution after it.  Each round is cut by a checkpoint;
nothing but one row of counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut


def _star(edges: DataFrame) -> DataFrame:
    """One large-star step and one small-star step over (a, b) with a > b."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a")
    return small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a > b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node but the smallest of each component.

    ``edges`` has two long columns; order, repeats and loops do not matter, rows with a null are left out.
    """
    one, two = (F.col(f"`{c}`") for c in edges.columns)
    now = cut(edges.select(F.greatest(one, two).alias("a"), F.least(one, two).alias("b")).filter("a > b and b is not null").distinct())

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = cut(_star(now))
        new = mark(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
