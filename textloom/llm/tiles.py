"""Rows that share a key, brought together in tiles of bounded size.

A key with many rows is cut into tiles by a hash before its rows are brought together, so
no task ever gathers such a group whole.  Which keys have many rows is known from the rows
that one in ``SHARE`` of the owners has; a key that is missed there becomes one tile, larger
than meant, which costs time and loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut

SHARE = 64
SENT = 200_000  # most hot keys that are broadcast; more are joined by a shuffle


def chosen(owner: Column) -> Column:
    """Whether an owner is among those that the hot keys are found from."""
    return F.pmod(F.xxhash64(owner, F.lit("sample")), F.lit(SHARE)) == 0


def hot_keys(some: DataFrame, key: str, tile: int) -> DataFrame:
    """(key, parts) of keys with several tiles, from the rows of the ``chosen`` owners."""
    n = some.groupBy(key).agg(F.count("*").alias("n"))
    return cut(n.filter(F.col("n") * SHARE > max(1, tile // 4)).select(key, F.ceil(F.col("n") * SHARE / tile).cast("int").alias("parts")))


def tiled(rows: DataFrame, hot: DataFrame, key: str, owner: str) -> DataFrame:
    """``rows`` with their key's ``parts`` (null if it is not hot) and the number of their ``tile`` within it."""
    n = hot.count()
    out = rows.join(F.broadcast(hot) if n <= SENT else hot, key, "left") if n else rows.withColumn("parts", F.lit(None).cast("int"))
    out = out.withColumn("tile", F.coalesce(F.pmod(F.xxhash64(owner), F.col("parts")), F.lit(0)).cast("int"))
    return out if n <= SENT else out.repartition(key, "tile")


def across(tiles: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """(rows1, rows2) for every two tiles of one key, from ``tiles`` (key, tile, rows)."""
    numbers = hot.filter("parts > 1").select(key, "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 2)).alias("tile1"))
    numbers = numbers.select(key, "tile1", F.explode(F.sequence(F.col("tile1") + 1, F.col("parts") - 1)).alias("tile2"))
    left, right = (tiles.select(key, F.col("tile").alias(f"tile{k}"), F.col("rows").alias(f"rows{k}")) for k in (1, 2))
    return numbers.join(left, [key, "tile1"]).join(right, [key, "tile2"]).select("rows1", "rows2")
