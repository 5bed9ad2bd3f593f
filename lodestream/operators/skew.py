"""Joins that a key holding a third of all rows cannot overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so there are at most ``1 / HOT_SHARE`` hot keys.
HOT_SHARE = 1 / 500


def hot_keys(big: DataFrame, key: str, least: int = 10_000) -> list:
    """Keys with at least ``HOT_SHARE`` of all rows and ``least`` rows: by their share at most 500."""
    counts = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = big.count()
    return [r[0] for r in counts.where(F.col("n") >= max(least, int(total * HOT_SHARE) + 1)).select(key).collect()]


def join_unique(big: DataFrame, unique: DataFrame, key: str, hot: list) -> DataFrame:
    """Inner join of ``big`` with a table that has each key once.

    The rows of the hot keys (a list from ``hot_keys``, at most 500) meet a broadcast of their at
    most 500 partners and are not shuffled; all others take an ordinary join.
    """
    if not hot:
        return big.join(unique, key)
    is_hot = F.col(key).isin(hot)
    return big.where(is_hot).join(F.broadcast(unique.where(is_hot)), key).unionByName(big.where(~is_hot).join(unique.where(~is_hot), key))
