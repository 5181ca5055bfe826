"""Joins against a side with one row per key, safe when one key holds a large share of the other side.

A plain shuffle join would send all rows of a hot key to one task. So the rows per key are counted first (a partial
aggregation, or a by-product of one that ran anyway). Without hot keys - the usual case - the join is a plain one. With
hot keys the left side is split: rows of hot keys meet a broadcast of just those keys, of which there are at most
(left rows / hot_rows), about ten thousand for ten billion rows; the other rows are shuffled as usual.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS, rows: str | None = None) -> DataFrame | None:
    """The keys with more than hot_rows rows, or None. `rows` names a column that already holds the count per key."""
    counted = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")) if rows is None else df.withColumn("_rows", F.col(rows))
    hot = cut(counted.where(F.col("_rows") > hot_rows).select(*on))
    return None if hot.isEmpty() else hot


def left_lookup(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None) -> DataFrame:
    """left LEFT JOIN right, where `right` has one row per key."""
    if hot is None:
        return left.join(right, on, "left")
    keys = F.broadcast(hot)
    few = F.broadcast(right.join(keys, on, "left_semi"))
    return left.join(keys, on, "left_semi").join(few, on, "left").unionByName(left.join(keys, on, "left_anti").join(right, on, "left"))


def anti_lookup(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None) -> DataFrame:
    """Left rows whose key is not in `right`."""
    keys = right.select(*on)
    if hot is None:
        return left.join(keys, on, "left_anti")
    few = F.broadcast(keys.join(F.broadcast(hot), on, "left_semi"))
    return left.join(few, on, "left_anti").join(keys.join(F.broadcast(hot), on, "left_anti"), on, "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
