"""Connected components of an edge table by alternating stars.

Large-star and small-star rounds (each a grouped minimum and an equi-join)
shorten all paths to the smallest id at once; a few rounds do for any
diameter met in practice, and the loop runs until nothing changes.  Every
round is a stage table in the shared folder, so lineage stays short and a
lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.stages import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``(u, v)`` with ``u > v``."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """``(x, y)`` pairs of ids -> ``(id, component)`` of every id that is not
    itself the smallest of its component."""
    e = staged(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
               .filter("u <> v").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        e = staged(_star(staged(_star(e, True), "star"), False), "edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
