"""Sums of model-sized vectors over all tasks, by feature range.

A task that reduces its rows to a vector of the model's size (counts, usage,
gradients) sends it in ranges of ``RANGE`` features: one binary value per
(key, range) that is not empty.  Ranges are folded in two levels: first by
range and one of ``SALTS`` shares of the tasks, then by range, so that the
scan keeps its whole parallelism and no task folds more than a share of all
partial vectors.  Rows of a range come sorted together and are folded one
after another; a task holds one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE = 8192
SALTS = 32
HELD_BYTES = 64 * 1024 * 1024       # of partial vectors in a task before they are sent


def ranges(size: int) -> Iterator[tuple[int, int, int]]:
    """(range, first feature, end) of a vector over ``size`` features."""
    for r, lo in enumerate(range(0, size, RANGE)):
        yield r, lo, min(size, lo + RANGE)


def fold_sorted(batches: Iterable[pa.RecordBatch], keys: Sequence[str], merge: Callable,
                dtype: str = "<f8") -> Iterator[tuple[tuple, np.ndarray]]:
    """(key values, folded vector) of rows that come sorted by ``keys``."""
    now, acc = None, None
    for rb in batches:
        blobs = rb.column(rb.schema.get_field_index("blob"))
        for i, key in enumerate(zip(*(rb.column(k).to_pylist() for k in keys))):
            value = np.frombuffer(blobs[i].as_buffer(), dtype)
            if now is None or key != now:
                if now is not None:
                    yield now, acc
                now, acc = key, value.copy()
            else:
                acc = merge(key, acc, value)
    if now is not None:
        yield now, acc


def many_tasks(df: DataFrame) -> bool:
    """Whether a scan of ``df`` may have more tasks than one level folds, by
    the plan's size estimate; unknown sizes count as large."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        return size > SALTS * int(split)
    except Exception:           # Spark Connect
        return True


def gathered(parts: DataFrame, keys: Sequence[str], merge: Callable, dtype: str = "<f8", wide: bool = True,
             by: Sequence[str] | None = None) -> DataFrame:
    """Partial vectors ``(*keys, blob)``, first level folded, brought
    together and sorted by ``keys`` for the last fold (``fold_sorted``), which
    the caller does; rows of equal ``by`` (default ``keys``) share a task."""
    keys = list(keys)
    if wide:
        def run(batches):
            for key, acc in fold_sorted(batches, [*keys, "salt"], merge, dtype):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(key, types)] + [pa.array([acc.tobytes()], pa.binary())],
                    names=[*keys, "blob"])
        from pyspark.sql.pandas.types import to_arrow_type
        types = [to_arrow_type(parts.schema[k].dataType) for k in keys]
        salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        parts = (salted.repartition(*keys, "salt").sortWithinPartitions(*keys, "salt")
                 .mapInArrow(run, parts.select(*keys, "blob").schema))
    return parts.repartition(*(by or keys)).sortWithinPartitions(*keys)
