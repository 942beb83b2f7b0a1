"""Joining rows to one value per group where a few groups hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the other columns of ``groups``, which holds each value of
    ``key`` once with the number of its rows in ``size`` (dropped).

    Groups of more than one in ``HOT_SHARE`` of all ``total`` rows are fewer
    than ``HOT_SHARE``, so their values are broadcast and their rows stay
    where they are; all others meet by a shuffle in which no key is large."""
    hot = groups.filter(F.col(size) * HOT_SHARE > F.lit(total))
    rest = groups.filter(F.col(size) * HOT_SHARE <= F.lit(total)).drop(size)
    marked = rows.join(F.broadcast(hot.drop(size).withColumn("_hot", F.lit(True))), key, "left")
    warm = marked.filter("_hot").drop("_hot")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return warm.unionByName(cold)
