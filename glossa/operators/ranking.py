"""Row numbers at scale.

``Window.partitionBy(g).orderBy(key)`` puts a whole group into one task,
and a global order puts the whole table into one.  For few, large groups
``row_number_scalable`` gives the same numbers without that:

1. rows are dealt into buckets that follow the order: by ranges of
   (group, order columns), sampled by Spark over full values of any type, or,
   where the first order column is a uniform number of a known range (a hash
   prefix), by equal widths of it;
2. rows are numbered inside (group, bucket) with a window: a group that
   holds a third of the rows is spread over its buckets;
3. the counts per (group, bucket) give prefix offsets, joined back.

Range buckets are written to the shared folder first, so every later step
sees the same ones, also after an executor is lost.  Ordering columns must
make the order total (end with an id).  Where groups are small and many, a
plain window is the better plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_number_scalable(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                        out_col: str = "rn", num_buckets: int | None = None,
                        bucket_key: Column | None = None,
                        key_range: tuple[float, float] | None = None) -> DataFrame:
    """Add ``out_col`` = 1-based row number inside ``group_cols`` ordered by
    ``order_cols`` (ascending, nulls first as in Spark).

    ``bucket_key`` with ``key_range``: a number that never decreases along
    the order and is uniform over the range; buckets are equal widths of it
    and nothing is sampled or written."""
    group_cols = list(group_cols)
    order = [_col(c) for c in order_cols]
    n = num_buckets or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if bucket_key is not None and key_range is not None:
        lo, hi = key_range
        part = F.floor((bucket_key - F.lit(lo)) * F.lit(n / (hi - lo)))
        keyed = df.withColumn("_bkt", F.coalesce(F.least(F.greatest(part, F.lit(0)), F.lit(n - 1)), F.lit(0)).cast("int"))
    else:
        from glossa.session import materialize
        keyed = materialize(df.repartitionByRange(n, *[F.col(c) for c in group_cols], *order)
                            .withColumn("_bkt", F.spark_partition_id()), "ranges")
    local = keyed.withColumn("_lrn", F.row_number().over(
        Window.partitionBy(*group_cols, "_bkt").orderBy(*order)))
    counts = keyed.groupBy(*group_cols, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    before = (Window.partitionBy(*group_cols).orderBy("_bkt")
              .rowsBetween(Window.unboundedPreceding, -1))
    # one row per (group, bucket); keys match null-safely (a null group is a group)
    offsets = counts.select(*[F.col(c).alias(f"_o_{c}") for c in group_cols], F.col("_bkt").alias("_o_bkt"),
                            F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    same = F.col("_bkt") == F.col("_o_bkt")
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return (local.join(offsets, same)
            .withColumn(out_col, (F.col("_lrn") + F.col("_off")).cast("long"))
            .drop("_bkt", "_lrn", "_off", "_o_bkt", *[f"_o_{c}" for c in group_cols]))
