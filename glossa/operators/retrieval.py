"""Retrieval: cosine scoring, top-k per query, judgments and metrics.

Scoring every query against every document is a dense product: both sides
are cut into blocks of bounded bytes, a block of queries meets its documents
in one task by a shuffle, pairs of blocks that cannot matter are skipped
exactly (``blocks``), and the task keeps only the best ``k`` per query.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_type

from glossa.operators.blocks import NORM_EPS, best_pairs
from glossa.operators.sae import _matrix

# Scores are rounded to 12 decimals before ranking: the same cosine computed
# for two identical documents at different positions of a matrix product
# can differ in the last bits, and such ties must go to the lower doc id.
SCORE_DECIMALS = 12
DEFAULT_STATE_BYTES = 192 * 1024 * 1024     # query vectors and running best k of a task
DEFAULT_BLOCK_BYTES = 32 * 1024 * 1024      # vectors of a document block
DEFAULT_WORK_BYTES = 64 * 1024 * 1024
TILE_ROWS = 2048                            # documents scored at once
PAIRS = 1 << 14                             # pairs scored by themselves at once
OUT_ROWS = 1 << 16                          # ranked rows of a record batch
PARTS = 64                                  # arrays of pairs that wait in a group of queries
HELD_ROWS = 1 << 16                         # documents whose columns are held before they are thinned out
# Fixed cut-offs of the evaluation.
K_VALUES = (1, 3, 5, 10, 20, 100, 1000)


def l2_normalize(col: Column | str) -> Column:
    """``v / max(||v||, 1e-12)`` as a Catalyst expression."""
    v = F.col(col) if isinstance(col, str) else col
    v = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(NORM_EPS)))


def _exact_topk_cols(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``scores``: column positions of the k largest values,
    ordered by (value desc, position asc); exact on ties."""
    n, d = scores.shape
    if k >= d:
        pos = np.broadcast_to(np.arange(d), (n, d))
        order = np.lexsort((pos, -scores), axis=-1)
        return np.take_along_axis(pos, order, 1), np.take_along_axis(scores, order, 1)
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    val = np.take_along_axis(scores, part, 1)
    kth = val.min(axis=1)
    for r in np.nonzero((scores >= kth[:, None]).sum(axis=1) > k)[0]:
        row = scores[r]
        above = np.nonzero(row > kth[r])[0]
        equal = np.nonzero(row == kth[r])[0][: k - above.size]
        part[r] = np.concatenate([above, equal])
        val[r] = row[part[r]]
    order = np.lexsort((part, -val), axis=-1)
    return np.take_along_axis(part, order, 1), np.take_along_axis(val, order, 1)


class _Best:
    """The best ``k`` documents of a block of queries, from documents streamed
    in id order.

    Once every query has ``k``, a product in single precision tells which
    pairs can still reach a query's k-th score; only these are scored in
    double precision and wait, as pairs, by group of ``rows`` queries.  A
    group is merged when half of ``k`` a query wait in it, so what waits is
    bounded in whatever order the documents come.  Of the documents that came
    by, only the columns of those that are among the best, or new, are held."""

    def __init__(self, keys, q_ids, mat, k, dim, work_bytes):
        """``mat`` is normalised in place."""
        self.keys, self.q_ids, self.k = keys, q_ids, k
        for s in range(0, len(mat), TILE_ROWS):
            part = mat[s:s + TILE_ROWS]
            part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), NORM_EPS)
        self.q = mat
        self.q32 = self.q.astype(np.float32)
        self.slack = (dim + 8) * 2.0 ** -22            # more than single precision can be off
        self.tile = max(1, min(TILE_ROWS, work_bytes // 8))
        self.rows = max(1, work_bytes // (64 * max(self.tile, k)))
        self.val = np.full((len(mat), k), -np.inf)
        self.at = np.zeros((len(mat), k), dtype=np.int32)
        self.columns, self.seen = [], 0                # ids and more of documents; how many came by
        self.held, self.least = 0, HELD_ROWS           # documents in ``columns``; more than this are thinned out
        self.waiting, self.waits = {}, {}              # by group: pairs in arrays, how many

    def docs(self, columns, mat):
        self.columns.append(columns)
        mat = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), NORM_EPS)
        for s in range(0, len(mat), self.tile):
            part = mat[s:s + self.tile]
            part32 = part.astype(np.float32)
            for r in range(0, len(self.q), self.rows):
                if self.seen < self.k:
                    self._first(r, part)
                else:
                    self._later(r, part, part32)
            self.seen += len(part)
            self.held += len(part)
        if self.held > self.least:
            self._thin()

    def _first(self, r, part):
        pos, val = _exact_topk_cols(np.round(self.q[r:r + self.rows] @ part.T, SCORE_DECIMALS), self.k)
        self._merge(r, val, (pos + self.held).astype(np.int32))

    def _later(self, r, part, part32):
        kth = self.val[r:r + self.rows, -1]
        near = self.q32[r:r + self.rows] @ part32.T >= (kth - self.slack)[:, None].astype(np.float32)
        many = np.count_nonzero(near)
        if not many:
            return
        if many * 8 > near.size:                       # as with equal vectors
            score = np.round(self.q[r:r + self.rows] @ part.T, SCORE_DECIMALS)
            row, col = np.nonzero(score > kth[:, None])
            score = score[row, col]
        else:
            row, col = np.nonzero(near)
            score = np.concatenate([np.einsum("ij,ij->i", self.q[r + row[i:i + PAIRS]], part[col[i:i + PAIRS]])
                                    for i in range(0, many, PAIRS)])
            score = np.round(score, SCORE_DECIMALS)
            above = score > kth[row]                   # an equal one has the higher id
            row, col, score = row[above], col[above], score[above]
        if len(row):
            g = r // self.rows
            self.waiting.setdefault(g, []).append((row.astype(np.int32), (self.held + col).astype(np.int32), score))
            self.waits[g] = self.waits.get(g, 0) + len(row)
            if self.waits[g] > len(kth) * max(self.k // 2, 8) or len(self.waiting[g]) >= PARTS:
                self._settle(g)

    def settle(self):
        for g in list(self.waiting):
            self._settle(g)

    def _settle(self, g):
        row, at, val = (np.concatenate(x) for x in zip(*self.waiting.pop(g)))
        del self.waits[g]
        order = np.argsort(row, kind="stable")
        row, at, val = row[order], at[order], val[order]
        r = g * self.rows
        n = min(self.rows, len(self.q) - r)
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
        more = np.full((n, int(place.max()) + 1), -np.inf)
        more_at = np.zeros(more.shape, dtype=np.int32)
        more[row, place] = val
        more_at[row, place] = at
        self._merge(r, more, more_at)

    def _merge(self, r, val, at):
        """Documents held come before new ones, so a stable sort by score
        leaves equal scores in id order."""
        end = r + len(val)
        val = np.concatenate([self.val[r:end], val], axis=1)
        at = np.concatenate([self.at[r:end], at], axis=1)
        o = np.argsort(-val, axis=1, kind="stable")[:, :self.k]
        self.val[r:end], self.at[r:end] = np.take_along_axis(val, o, 1), np.take_along_axis(at, o, 1)

    def _thin(self):
        """Only documents that are among the best of a query stay in
        ``columns``, in the same order."""
        self.settle()
        some = np.zeros(self.held, dtype=bool)
        some[self.at[:, :min(self.seen, self.k)]] = True
        place = np.cumsum(some, dtype=np.int32) - 1
        for r in range(0, len(self.q), self.rows):
            self.at[r:r + self.rows] = place[self.at[r:r + self.rows]]
        keep = pa.array(np.flatnonzero(some))
        self.columns = [[pa.concat_arrays(c).take(keep) for c in zip(*self.columns)]]
        self.held = len(keep)
        self.least = 2 * self.held + HELD_ROWS

    def floor(self) -> float:
        self.settle()
        return float(self.val[:, -1].min()) if self.seen >= self.k else -2.0

    def best(self, schema: pa.Schema):
        """Record batches of the ranked documents of all queries."""
        self.settle()
        m = min(self.seen, self.k)
        if not m:
            return
        columns = [pa.concat_arrays(c) for c in zip(*self.columns)]
        step = max(1, OUT_ROWS // m)
        for r in range(0, len(self.q), step):
            at = self.at[r:r + step, :m]
            n = len(at)
            doc, *more = (c.take(pa.array(at.ravel())) for c in columns)
            yield pa.RecordBatch.from_arrays(
                [*(pa.repeat(v, n * m) for v in self.keys), self.q_ids.take(pa.array(np.repeat(np.arange(r, r + n), m))), doc,
                 pa.array(self.val[r:r + step, :m].ravel()), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), n)), *more],
                schema=schema)


def _block_kernel(dim: int, k: int, work_bytes: int, n_by: int, schema: T.StructType | None):
    """Per block of queries: the best ``k`` documents of every query or,
    without ``schema``, ``(pair, floor)``: the lowest k-th score.  Rows
    ``(pair, kind, qid, doc_id, v, *by, *carry)`` come sorted by block, queries
    first, then documents in id order, which are streamed."""
    out = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields]) if schema else None

    def close(pair, state):
        if state is None:
            return
        if out is None:
            yield pa.RecordBatch.from_pydict({"pair": pa.array([pair], pa.int64()), "floor": pa.array([state.floor()])})
        else:
            yield from state.best(out)

    def joined(held):
        ids, mat = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
        held.clear()
        return ids, mat

    def run(batches):
        now, held, keys, state = None, [], None, None
        for rb in batches:
            pair = rb.column(0).to_numpy(zero_copy_only=False)
            kind = rb.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (kind[1:] != kind[:-1]))) if len(pair) else []
            for i, j in zip(cut, np.append(cut[1:], len(pair))):
                part = rb.slice(i, j - i)
                if pair[i] != now:
                    yield from close(now, state)
                    now, held, keys, state = pair[i], [], None, None
                mat, valid = _matrix(part.column(4), dim)
                mat, part = mat[valid], part.filter(pa.array(valid))
                if not part.num_rows:
                    continue
                if not kind[i]:
                    keys = keys or [part.column(5 + c)[0] for c in range(n_by)]
                    held.append((part.column(2), mat))
                    continue
                if state is None and held:
                    state = _Best(keys, *joined(held), k, dim, work_bytes)
                if state is not None:
                    state.docs([part.column(c) for c in (3, *range(5 + n_by, part.num_columns))], mat)
        yield from close(now, state)
    return run


def _global_cut(cand: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    wq = Window.partitionBy(*by, "qid").orderBy(F.col("score").desc(), F.col("doc_id"))
    return cand.withColumn("rank", F.row_number().over(wq)).filter(F.col("rank") <= k)


def score_topk(queries: DataFrame, docs: DataFrame, k: int,
               qid_col: str = "qid", doc_col: str = "doc_id", vec_col: str = "embedding", by: Sequence[str] = (),
               state_bytes: int = DEFAULT_STATE_BYTES, block_bytes: int = DEFAULT_BLOCK_BYTES,
               work_bytes: int = DEFAULT_WORK_BYTES, report: dict | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """J4 + L4: ``(*by, qid, doc_id, score, rank, *carry)``: the ``min(k,
    n_docs)`` documents of highest cosine per query; ties go to the lower doc
    id.  Ids keep their types.  With ``by`` (columns of both sides, not null)
    queries meet the documents of equal values only.  ``carry``: columns of
    the documents that come along.

    Both sides are written once and cut into blocks of bounded bytes
    (``state_bytes``: query vectors and running best ``k``; ``block_bytes``:
    document vectors); pairs of blocks that cannot hold one of the best are
    skipped (``blocks``).  A block of queries meets all its documents in one
    task, so its best ``k`` are final and no candidates travel.  Rows of an id
    that several queries have are cut to ``k`` together.  Zero vectors score
    0; null vectors and vectors of another length than the queries' are
    neither queries nor documents.
    """
    by = list(by)
    schema = T.StructType([*(docs.schema[c] for c in by), T.StructField("qid", queries.schema[qid_col].dataType),
                           T.StructField("doc_id", docs.schema[doc_col].dataType), T.StructField("score", T.DoubleType()),
                           T.StructField("rank", T.IntegerType()), *(docs.schema[c] for c in carry)])

    def vec(df):
        kind = df.schema[vec_col].dataType
        narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
        return F.col(vec_col).cast("array<float>" if narrow else "array<double>").alias("v")

    kernel_of = lambda dim, ranked: _block_kernel(dim, k, work_bytes, len(by), schema if ranked else None)
    found = best_pairs(queries.select(*by, F.col(qid_col).alias("qid"), vec(queries)),
                       docs.select(*by, F.col(doc_col).alias("doc_id"), vec(docs), *carry),
                       k, by, list(carry), kernel_of, schema, state_bytes, block_bytes, report)
    if found is None:
        return queries.sparkSession.createDataFrame([], schema)
    run, repeated = found
    if repeated is None:
        return run
    same = run["qid"].eqNullSafe(repeated["_qid"])
    for c in by:
        same = same & run[c].eqNullSafe(repeated[f"_{c}"])
    return run.join(repeated, same, "left_anti").unionByName(
        _global_cut(run.join(repeated, same, "left_semi"), k, by).select(*run.columns))


def exclude_self(run: DataFrame, before_cut: bool = False, k: int | None = None) -> DataFrame:
    """Drop ``doc_id = qid`` and renumber the ranks.  Default: after the
    cut (k-1 remain for a query that found itself).  ``before_cut`` with
    ``k``: the run was retrieved with k+1 per query and k are kept."""
    out = run.filter(F.col("doc_id") != F.col("qid"))
    wq = Window.partitionBy("qid").orderBy(F.col("rank"))
    out = out.withColumn("rank", F.row_number().over(wq))
    if before_cut and k is not None:
        out = out.filter(F.col("rank") <= k)
    return out


def ideal_from_grades(grades: DataFrame, keys: Iterable[str], ks: Iterable[int]) -> DataFrame:
    """Ideal DCG@k and the number of relevant documents per query from
    ``(*keys, rel, n)``: ``n`` judged documents of grade ``rel`` > 0.

    The ideal list is the grades in descending order, so grade g fills the
    positions after the counts of the higher grades; only positions <= k
    are summed.  Works from counts - no window over the judgments of a
    query, however many it has."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col("rel").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    g = grades.filter(F.col("rel") > 0).withColumn(
        "_start", F.coalesce(F.sum("n").over(w), F.lit(0)))
    aggs = [F.sum("n").alias("n_rel")]
    for k in ks:
        last = F.least(F.col("_start") + F.col("n"), F.lit(k))
        disc = F.aggregate(F.sequence(F.col("_start") + 1, last), F.lit(0.0),
                           lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1.0)))
        aggs.append(F.sum(F.when(F.col("_start") < k, F.col("rel") * disc).otherwise(0.0))
                    .alias(f"idcg_{k}"))
    return g.groupBy(*keys).agg(*aggs)


def metrics_from_judged(judged: DataFrame, ideal: DataFrame, ks: Iterable[int] = K_VALUES,
                        by: Iterable[str] = ()) -> DataFrame:
    """A28 from a run whose rows carry their grade (``rel``, 0 = not
    relevant) and per-query ideal values (``ideal_from_grades``)."""
    by = list(by)
    ks = [int(k) for k in ks]
    keys = by + ["qid"]
    wr = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    is_rel = (F.col("rel") > 0).cast("long")
    judged = judged.withColumn("hits_so_far", F.sum(is_rel).over(wr))
    gain = F.col("rel") / F.log2(F.col("rank") + F.lit(1.0))
    prec = F.col("hits_so_far") / F.col("rank")
    aggs = []
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [F.sum(F.when(inside, gain).otherwise(0.0)).alias(f"dcg_{k}"),
                 F.sum(F.when(inside & (F.col("rel") > 0), 1).otherwise(0)).alias(f"hit_{k}"),
                 F.sum(F.when(inside & (F.col("rel") > 0), prec).otherwise(0.0)).alias(f"ap_{k}")]
    per_q = judged.groupBy(*keys).agg(*aggs)
    q = per_q.join(ideal, keys)
    cols = []
    for k in ks:
        cols += [F.struct(F.lit("NDCG").alias("metric"), F.lit(k).alias("k"),
                          (F.col(f"dcg_{k}") / F.col(f"idcg_{k}")).alias("value")),
                 F.struct(F.lit("MAP").alias("metric"), F.lit(k).alias("k"),
                          (F.col(f"ap_{k}") / F.col("n_rel")).alias("value")),
                 F.struct(F.lit("Recall").alias("metric"), F.lit(k).alias("k"),
                          (F.col(f"hit_{k}") / F.col("n_rel")).alias("value")),
                 F.struct(F.lit("P").alias("metric"), F.lit(k).alias("k"),
                          (F.col(f"hit_{k}") / F.lit(float(k))).alias("value"))]
    long = q.select(*keys, F.explode(F.array(*cols)).alias("m")).select(*keys, "m.*")
    return long.groupBy(*by, "metric", "k").agg(F.avg("value").alias("value"))


def retrieval_metrics(run: DataFrame, qrels: DataFrame,
                      ks: Iterable[int] = K_VALUES, by: Iterable[str] = ()) -> DataFrame:
    """``(*by, metric, k, value)`` with metric in NDCG, MAP, Recall,
    P: per query, then the mean over queries that are both judged (at least
    one rel > 0) and retrieved.  ``qrels`` is an explicit judgment table.

    Definitions (linear gain, log2 discount): DCG@k = sum rel_i/log2(i+1)
    over ranks i <= k; IDCG from the judgments sorted by rel; AP@k = sum of
    precision at each relevant rank <= k over the number of relevant docs;
    Recall@k = relevant in top k / relevant; P@k = relevant in top k / k.
    """
    by = list(by)
    ks = [int(k) for k in ks]
    keys = by + ["qid"]
    judged = (run.join(qrels.select(*keys, "doc_id", "rel"), keys + ["doc_id"], "left")
              .withColumn("rel", F.coalesce(F.col("rel"), F.lit(0))))
    grades = (qrels.filter(F.col("rel") > 0).groupBy(*keys, "rel")
              .agg(F.count(F.lit(1)).alias("n")))
    return metrics_from_judged(judged, ideal_from_grades(grades, keys, ks), ks, by)


def pending(requested: DataFrame, existing: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Requested keys without a result yet (``left_anti``), to be
    computed before any scoring; ``overwrite`` callers skip this."""
    return requested.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def evaluate_datasets(spark, datasets: dict, factory, model: str, ks: Iterable[int] = K_VALUES,
                      existing: DataFrame | None = None, drop_title_when_prefixed: bool = True,
                      path: str | None = None) -> DataFrame | None:
    """D9 end to end: ``(dataset, metric, k, value)``.  ``datasets`` maps a
    name to its line tables ``(queries, corpus, judgments)`` (line keys of one
    type); texts get the prefixes of ``model`` (P3, P4), are encoded by
    ``factory`` (U1), ranked (D8) and scored against the judgments (A28).

    All datasets go through one plan with the dataset as a key, so the number
    of jobs does not depend on how many there are.  With ``path`` the results
    are kept there (K4); datasets that ``existing`` or ``path`` has results
    for are skipped before anything is read.  None when nothing is left to
    score."""
    from functools import reduce

    from glossa.functions import text as tx
    from glossa.operators import encoder
    from glossa.sources import readers, sinks
    done = {r[0] for r in existing.select("dataset").distinct().collect()} if existing is not None else set()
    if path is not None:
        kept = sinks.existing_results(spark, path, ["dataset"])
        done |= {r[0] for r in kept.collect()} if kept is not None else set()
    todo = {name: tables for name, tables in datasets.items() if name not in done}     # a configured list
    if not todo:
        return None
    ks, by = [int(k) for k in ks], ["dataset"]
    queries, corpus, judgments = (
        reduce(DataFrame.unionByName, (t[i].select(F.lit(name).alias("dataset"), "line_key", "value")
                                       for name, t in todo.items())) for i in range(3))
    q = readers.parse_queries(queries, by=by).select("dataset", "qid", tx.with_query_prefix("text", F.lit(model)).alias("text"))
    d = readers.parse_corpus(corpus, by=by).select("dataset", "doc_id", tx.with_passage_prefix(
        "title", "body", F.lit(model), drop_title_when_prefixed).alias("text"))
    run = score_topk(encoder.encode_texts(q, factory, keep=("dataset", "qid")),
                     encoder.encode_texts(d, factory, keep=("dataset", "doc_id")), max(ks), by=by)
    found = retrieval_metrics(run, readers.parse_qrels(judgments, by=by), ks, by=by).select("dataset", "metric", "k", "value")
    if path is None:
        return found
    sinks.write_results(spark, found, path, by)
    return spark.read.parquet(path).filter(F.col("dataset").isin(list(todo))).select("dataset", "metric", "k", "value")
