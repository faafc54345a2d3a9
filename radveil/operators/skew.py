"""Lookup joins that survive hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows; so at most 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 1 / 200
#: Below this many rows nothing is hot.
HOT_ROWS = 100_000


def hot_keys(df: DataFrame, keys: list[str], rows: int | None = None) -> list:
    """The keys that hold HOT_SHARE of the rows or more: at most 1 / HOT_SHARE rows reach the driver.

    The counts are aggregated before the shuffle. ``rows``: how many df has at most, where that is known.
    """
    if rows is not None and rows < HOT_ROWS:
        return []
    return hot_of(df.groupBy(*keys).agg(F.count("*").alias("__n")), keys, "__n")


def hot_of(counts: DataFrame, keys: list[str], n: str) -> list:
    """The same where the rows of each key are counted already, in column ``n``."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    if total < HOT_ROWS:
        return []
    return counts.where(F.col(n) >= total * HOT_SHARE).select(*keys).collect()


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: list | None = None) -> DataFrame:
    """left join right where ``right`` holds each key once; nulls match nothing.

    Rows of hot keys meet a broadcast of those keys' right rows, whose number is bounded by
    1 / HOT_SHARE; all others go through an ordinary join. ``hot``: the hot keys where they are known; else they are counted.
    """
    if hot is None:
        hot = hot_keys(left.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))), keys)
    if not hot:
        return left.join(right, keys, how)
    few = left.sparkSession.createDataFrame(hot, left.select(*keys).schema)
    is_hot = F.broadcast(few.withColumn("__hot", F.lit(True)))
    marked = left.join(is_hot, keys, "left")
    hot_right = F.broadcast(right.join(F.broadcast(few), keys, "left_semi"))
    a = marked.where(F.col("__hot")).drop("__hot").join(hot_right, keys, how)
    b = marked.where(F.col("__hot").isNull()).drop("__hot").join(right, keys, how)
    return a.unionByName(b)
