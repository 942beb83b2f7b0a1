"""Vector tables: which rows count, and their integers in numpy.

A row is kept when its vector is neither null nor holds a null or non-finite
entry, and has the table's length: the most frequent one among such vectors
(the longer of equally frequent ones).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vector_length(df: DataFrame, vec_col: str) -> int:
    """The table's vector length, 0 where no row can be kept."""
    v = F.col(vec_col)
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    top = df.filter(ok).groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return int(top[0]["n"]) if top else 0


def kept_vectors(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of kept vectors of a list column and their entries."""
    lengths = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    rows = np.nonzero(lengths == dim)[0]
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(rows) < len(col):
        starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        x = flat[starts[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    else:
        x = flat.reshape(len(rows), dim)
    good = np.isfinite(x).all(axis=1)
    return (rows, x) if good.all() else (rows[good], x[good])


def floors(x: np.ndarray, scale: float, most: float) -> np.ndarray:
    """``floor(scale * x)`` as int64; values beyond ``most`` are an error,
    since the sums that follow could not be held exactly."""
    y = np.floor(x * scale)
    if y.size and np.abs(y).max() > most:
        raise ValueError(f"a vector entry times {scale:g} is beyond {most:g}")
    return y.astype(np.int64)
