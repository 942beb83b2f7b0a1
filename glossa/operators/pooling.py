"""Masked mean pooling of token states."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from glossa.operators.sae import _matrix

POOL_EPS = 1e-9     # fixed: denominator clamp of the masked mean


def mean_pool(tokens: DataFrame, doc_col: str = "doc", mask_col: str = "mask",
              vec_col: str = "hidden", out_col: str = "embedding") -> DataFrame:
    """One vector per document, ``sum(h * mask) / max(sum(mask), 1e-9)``.

    An Arrow batch is reduced to one row per document it holds (masked sum,
    mask sum): token rows of a document usually sit together, so about one
    row per document reaches the shuffle, and a document of very many tokens
    sends one per batch.  These rows come sorted by document and are added
    as whole vectors, segment by segment.  Null or wrong-size vectors count
    as masked out."""
    doc_type = tokens.schema[doc_col].dataType
    schema = T.StructType([T.StructField("_doc", doc_type),
                           T.StructField("_s", T.ArrayType(T.DoubleType())),
                           T.StructField("_m", T.DoubleType())])
    doc_arrow = to_arrow_type(doc_type)
    dim = tokens.select(F.max(F.size(vec_col))).first()[0] or 0
    src = tokens.select(F.col(doc_col).alias("_doc"), F.col(mask_col).cast("double").alias("_mask"),
                        F.col(vec_col).alias("_h"))

    def rows(docs, sums, masks):
        offsets = pa.array(np.arange(len(masks) + 1, dtype=np.int32) * dim)
        return pa.RecordBatch.from_arrays(
            [docs, pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1))), pa.array(masks)],
            names=["_doc", "_s", "_m"])

    def segments(docs, x, m):
        """Documents in order of appearance with their sums."""
        coded = pc.dictionary_encode(docs, null_encoding="encode")
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary)))
        return coded.dictionary, np.add.reduceat(x[order], starts, axis=0), np.add.reduceat(m[order], starts)

    def partial(batches):
        for rb in batches:
            if rb.num_rows:
                x, valid = _matrix(rb.column("_h"), dim)
                m = np.nan_to_num(rb.column("_mask").to_numpy(zero_copy_only=False).astype(np.float64))
                m = np.where(valid, m, 0.0)
                yield rows(*segments(rb.column("_doc"), x * m[:, None], m))

    def whole(batches):
        held = None                     # the last document: it may go on in the next batch
        for rb in batches:
            if not rb.num_rows:
                continue
            docs, x = rb.column("_doc"), _matrix(rb.column("_s"), dim)[0]
            m = rb.column("_m").to_numpy(zero_copy_only=False)
            if held is not None:
                docs = pa.concat_arrays([held[0], docs])
                x, m = np.concatenate([held[1], x]), np.concatenate([held[2], m])
            docs, x, m = segments(docs, x, m)
            yield finish(docs[:-1], x[:-1], m[:-1])
            held = docs[-1:], x[-1:], m[-1:]
        if held is not None:
            yield finish(*held)

    def finish(docs, x, m):
        out = rows(docs.cast(doc_arrow), x / np.maximum(m, POOL_EPS)[:, None], m)
        return pa.RecordBatch.from_arrays([out.column(0), out.column(1)], names=[doc_col, out_col])

    sums = src.mapInArrow(partial, schema).repartition("_doc").sortWithinPartitions("_doc")
    return sums.mapInArrow(whole, T.StructType([T.StructField(doc_col, doc_type),
                                                T.StructField(out_col, T.ArrayType(T.DoubleType()))]))
