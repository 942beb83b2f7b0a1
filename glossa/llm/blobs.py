"""Merging one fixed-size summary per task into one, by stages.

A task's summary (sums, a spectrum) has the size of the model, not of its
rows.  The summaries are merged ``fan_in`` at a time in tasks, level by
level, until one is left; only that one reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from glossa.llm.stages import remove, small_batches, store

BLOB = "blob binary"


def merged(summaries: DataFrame, merge: Callable[[bytes, bytes], bytes], fan_in: int = 32) -> bytes | None:
    """The merge of all blobs of the one-column table ``summaries`` (None
    without any); ``merge`` is associative."""
    spark = summaries.sparkSession

    def fold(batches):
        acc = None
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                acc = blob if acc is None else merge(acc, blob)
        if acc is not None:
            yield pa.RecordBatch.from_pydict({"blob": pa.array([acc], pa.binary())})

    path, level = store(summaries, "summaries")
    n = level.count()
    with small_batches(spark, 16):
        while n > 1:
            n = -(-n // fan_in)
            before, (path, level) = path, store(level.repartition(n).mapInArrow(fold, BLOB), "merged")
            remove(spark, before)
        found = level.toArrow().column(0).to_pylist()
    remove(spark, path)
    return found[0] if found else None
