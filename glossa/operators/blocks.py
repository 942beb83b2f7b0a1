"""Best k documents per query by pairs of vector blocks, exactly.

Both sides are staged once (an encoder in front of them runs once per text)
and cut into blocks bounded by bytes: a query block by its vectors and
running best k, a document block by its vectors.  Blocks follow the vectors:
every vector goes to the nearest of a few pivots (documents picked by a hash
of their id), a pivot's vectors are cut into as many blocks as they need,
and a block knows the widest angle to its pivot.  Two blocks can hold no
cosine above ``cos(angle of the pivots - both widest angles)``.

A query block meets document blocks in one task by a shuffle, in two rounds.
First the blocks of highest bound that together hold ``2 k`` documents or
more; the lowest k-th best score of its queries is then its floor, the only
thing kept of this round.  In the second round it meets all blocks whose
bound reaches the floor, and its ranked documents are the result: they need
no other shuffle.  Nothing that could be among the best k is skipped.

The driver handles block counts and at most ``MAX_PIVOTS`` vectors; the list
of pairs is a table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.operators.sae import _matrix
from glossa.session import cores, materialize, remove_table

NORM_EPS = 1e-12                       # torch-style norm clamp
MAX_PIVOTS = 256
BOUND_SLACK = 1e-7                     # of a bound, for rounding in angles
MAX_TASKS = 20_000                     # that a round is cut into
LEAST_ROWS = 1024                      # of a query block that is cut for parallelism only
ZERO = -1                              # cell of zero vectors: their cosine is 0 with everything


def _unit(mat: np.ndarray) -> np.ndarray:
    return mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), NORM_EPS)


def placed(df: DataFrame, pivots: np.ndarray | None, dim: int) -> DataFrame:
    """Rows of a usable vector with ``cell`` (the nearest pivot) and
    ``angle`` to it."""
    if pivots is None:
        return df.filter(F.size("v") == dim).withColumn("cell", F.lit(0)).withColumn("angle", F.lit(0.0))
    names = df.columns

    def run(batches):
        for rb in batches:
            x, valid = _matrix(rb.column("v"), dim)
            rows = np.nonzero(valid)[0]
            x = x[rows]
            size = np.linalg.norm(x, axis=1)
            near = (x / np.maximum(size, NORM_EPS)[:, None]) @ pivots.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(rows)), cell], -1.0, 1.0))
            zero = size < NORM_EPS              # shorter ones are no unit vectors after the clamp
            part = rb.take(pa.array(rows)) if len(rows) < rb.num_rows else rb
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(np.where(zero, ZERO, cell).astype(np.int32)),
                 pa.array(np.where(zero, 0.0, angle))], names=[*names, "cell", "angle"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()),
                                            T.StructField("angle", T.DoubleType())]))


def blocked(rows: DataFrame, by: Sequence[str], rows_per_block: int, name: str) -> DataFrame:
    """Stage table of ``placed`` rows with ``sub``, the block inside a cell."""
    keys = [*by, "cell"]
    need = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_block)).cast("int").alias("_need"))
    sub = F.pmod(F.xxhash64("_row"), F.col("_need")).cast("int")
    return materialize(rows.join(need, keys).withColumn("sub", sub).drop("_need"), name)


def block_list(rows: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
    return rows.groupBy(*by, F.col("cell").alias(f"{prefix}c"), F.col("sub").alias(f"{prefix}s")).agg(
        F.count(F.lit(1)).alias(f"{prefix}n"), F.max("angle").alias(f"{prefix}r"))


def block_pairs(queries: DataFrame, docs: DataFrame, by: Sequence[str], pivots: np.ndarray | None, k: int) -> DataFrame:
    """Stage table of all block pairs: ``pair``, the query block; ``bound`` of
    any cosine in the pair and ``first``, whether it is in the first round."""
    spark = queries.sparkSession
    q = materialize(block_list(queries, by, "q").withColumn("pair", F.monotonically_increasing_id()), "query-block-list")
    d = block_list(docs, by, "d")
    pairs = q.join(d, list(by)) if by else q.crossJoin(d)       # lists of blocks, not rows
    if pivots is None:
        pairs = pairs.withColumn("bound", F.lit(1.0))
    else:
        angles = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
        table = spark.createDataFrame([(i, j, float(a)) for i, row in enumerate(angles) for j, a in enumerate(row)],
                                      "qc int, dc int, between double")        # at most MAX_PIVOTS squared
        gap = F.greatest(F.lit(0.0), F.col("between") - F.col("qr") - F.col("dr"))
        pairs = pairs.join(F.broadcast(table), ["qc", "dc"], "left").withColumn(
            "bound", F.when(F.col("between").isNull(), F.lit(0.0)).otherwise(F.cos(gap)) + F.lit(BOUND_SLACK))
    order = Window.partitionBy("pair").orderBy(F.desc("bound"), "dc", "ds")
    before = F.coalesce(F.sum("dn").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return materialize(pairs.withColumn("first", before < F.lit(2 * k))
                       .select("pair", *by, "qc", "qs", "dc", "ds", "bound", "first"), "block-pairs")


def scored(pairs: DataFrame, n_blocks: int, queries: DataFrame, docs: DataFrame, by: Sequence[str], carry: Sequence[str],
           kernel, schema) -> DataFrame:
    """What the kernel makes of every query block (``pair``) and the document
    blocks that ``pairs`` has for it."""
    q_type, d_type = queries.schema["qid"].dataType, docs.schema["doc_id"].dataType
    at = lambda rows, ids, c: ids.select("pair", *by, F.col(f"{c}c").alias("cell"), F.col(f"{c}s").alias("sub")) \
        .join(rows, [*by, "cell", "sub"])
    null = lambda t: F.lit(None).cast(t)
    q_rows = at(queries, pairs.select("pair", *by, "qc", "qs").distinct(), "q").select(
        "pair", F.lit(0).alias("kind"), "qid", null(d_type).alias("doc_id"), "v", *by,
        *(null(docs.schema[c].dataType).alias(c) for c in carry))
    d_rows = at(docs, pairs, "d").select("pair", F.lit(1).alias("kind"), null(q_type).alias("qid"), "doc_id", "v", *by, *carry)
    return (q_rows.unionByName(d_rows).repartition(max(1, min(n_blocks, MAX_TASKS)), "pair")
            .sortWithinPartitions("pair", "kind", "doc_id").mapInArrow(kernel, schema))


def best_pairs(queries: DataFrame, docs: DataFrame, k: int, by: Sequence[str], carry: Sequence[str], kernel_of,
               schema: T.StructType, state_bytes: int, block_bytes: int,
               report: dict | None = None) -> tuple[DataFrame, DataFrame | None] | None:
    """The ranked best ``k`` documents of every query row, from ``(*by, qid,
    v)`` and ``(*by, doc_id, v, *carry)``, and the table ``(*_by, _qid)`` of
    ids that several query rows have (None: no such id); None without queries
    or documents.  ``kernel_of(dim, ranked)`` gives the task of a round.
    ``report`` is filled with the numbers of pairs."""
    spark = queries.sparkSession
    row = F.monotonically_increasing_id().alias("_row")
    q0, d0 = materialize(queries.select("*", row), "queries"), materialize(docs.select("*", row), "documents")
    n_q, dim = q0.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_d = d0.filter(F.size("v") == dim).count()
    if not n_q or dim <= 0 or not n_d:
        return None
    repeated = materialize(q0.groupBy(*(F.col(c).alias(f"_{c}") for c in by), F.col("qid").alias("_qid"))
                           .agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "repeated-queries")
    repeated = None if repeated.isEmpty() else repeated
    # a query: its vector in both precisions, and k scores and places, half as many waiting
    q_rows = max(1, state_bytes // (dim * 12 + k * 24))
    q_rows = min(q_rows, max(LEAST_ROWS, -(-n_q // (3 * cores(spark)))))
    d_rows = max(1, block_bytes // (dim * 8))
    pivots = None
    if n_d > d_rows:
        picked = d0.filter(F.size("v") == dim).orderBy(F.xxhash64("doc_id"), "_row") \
            .limit(min(MAX_PIVOTS, 2 * -(-n_d // d_rows))).select("v").toArrow().column(0)
        pivots = _unit(np.array(picked.to_pylist(), dtype=np.float64))
        pivots = pivots[np.linalg.norm(pivots, axis=1) > 0.5]           # zero vectors are no pivots
        pivots = pivots if len(pivots) else None
    q = blocked(placed(q0, pivots, dim), by, q_rows, "query-blocks")
    d = blocked(placed(d0, pivots, dim), by, d_rows, "document-blocks")
    remove_table(q0)
    remove_table(d0)
    pairs = block_pairs(q, d, by, pivots, k)
    counts = {r["first"]: r["count"] for r in pairs.groupBy("first").count().collect()}
    n_blocks = pairs.select("pair").distinct().count()
    left, n_rest, some = counts.get(False, 0), 0, pairs
    if left:
        floors = scored(pairs.filter("first"), n_blocks, q, d, by, carry, kernel_of(dim, False),
                        T.StructType([T.StructField("pair", T.LongType()), T.StructField("floor", T.DoubleType())]))
        some = materialize(pairs.join(floors, "pair").filter(F.col("first") | (F.col("bound") >= F.col("floor"))).drop("floor"),
                           "block-pairs")
        n_rest = some.filter(~F.col("first")).count()
    if report is not None:
        report.update(pairs=sum(counts.values()), first=counts.get(True, 0), second=n_rest, skipped=left - n_rest)
    return scored(some, n_blocks, q, d, by, carry, kernel_of(dim, True), schema), repeated
