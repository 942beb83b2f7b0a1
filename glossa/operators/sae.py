"""Sparse-dictionary (SAE) jobs over an embeddings table.

The dictionary is a small table ``atoms(feature INT, enc ARRAY<DOUBLE>,
dec ARRAY<DOUBLE>)``: ``enc`` is row ``feature`` of the encoder weight and
``dec`` column ``feature`` of the decoder weight.  Activations are
``relu(x . enc_f)``; the top ``k`` per row are kept (ties: lower feature
id first) and decoded as ``sum value_f * dec_f``.

The product of every row with every atom is dense, so it is computed in
Arrow batches inside ``mapInArrow`` with numpy, never as exploded rows.  The
weights are files that executors map into memory (``weights``); whatever the
number of blocks, an operator is one node and one scan: a kernel walks the
blocks for each part of a batch with a running top-k.  Decoding gathers the
``k`` decoder rows of a row's features.  A task holds a product of at most
``work_bytes`` beside the mapped block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from glossa.operators.partials import HELD_BYTES, fold_sorted, gathered, many_tasks, ranges
from glossa.operators.weights import DEFAULT_BLOCK_BYTES, SaeModel, load_model  # noqa: F401

# Fixed values of the method.
FIRE_EPS = 1e-6            # a feature fires when |relu(x . enc)| > 1e-6
USAGE_TEMPERATURE = 1e4    # sigmoid temperature of the feature-usage estimate
FVU_EPS = 1e-8             # denominator guard of the unexplained variance

DEFAULT_WORK_BYTES = 64 * 1024 * 1024     # rows x features buffers per part of a batch

FEAT_IDX = "feat_idx"
FEAT_VAL = "feat_val"
KTH = "kth_value"
RECON = "recon"
RECON_MASKED = "recon_masked"
FEAT_RANK = "feat_rank"


# ---------------------------------------------------------------------------
# numpy helpers used inside tasks
# ---------------------------------------------------------------------------

def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense ``(n, dim)`` float64 matrix of a list column and a validity mask
    (null vectors and vectors of another length are invalid, zero rows)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    valid = lens == dim
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n and valid.all():
        return flat.reshape(n, dim), valid
    out = np.zeros((n, dim))
    rows = np.nonzero(valid)[0]
    if rows.size:
        starts = np.cumsum(lens) - lens
        out[rows] = flat[starts[rows][:, None] + np.arange(dim)]
    return out, valid


def _ragged(col: pa.Array, fill, dtype) -> tuple[np.ndarray, np.ndarray]:
    """List column -> padded ``(n, width)`` matrix and lengths."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    width = int(lens.max()) if n else 0
    out = np.full((n, width), fill, dtype=dtype)
    if width:
        flat = col.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(n), lens)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        out[rows, pos] = flat
    return out, lens


def _list(values: np.ndarray, keep: np.ndarray, typ: pa.DataType) -> pa.Array:
    """Rows of ``values`` where ``keep`` -> list array (row order kept)."""
    counts = keep.sum(axis=1)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                    pa.array(values[keep], typ))


# Activations are ranked by their value rounded to 12 decimals: two equal
# atoms can give values that differ in the last bits depending on their
# position in the matrix product, and such ties must go to the lower id.
RANK_DECIMALS = 12


def _rowwise_sorted(idx: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort each row by value descending (at the rank precision), then
    feature ascending."""
    order = np.lexsort((idx, -np.round(val, RANK_DECIMALS)), axis=-1)
    return np.take_along_axis(idx, order, 1), np.take_along_axis(val, order, 1)


def _block_topk(raw: np.ndarray, k: int, lo: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest of each row of ``raw`` (ReLU activations of the block
    that starts at ``lo``), unsorted; at the rank precision equal values go
    to the lower feature id."""
    n, d = raw.shape
    if k >= d:
        return np.broadcast_to(np.arange(lo, lo + d), (n, d)), raw
    part = np.argpartition(-raw, k - 1, axis=1)[:, :k]
    val = np.take_along_axis(raw, part, 1)
    kth = val.min(axis=1)
    # argpartition breaks ties at the boundary arbitrarily; redo those rows
    near = (raw >= (kth - 2 * 10.0 ** -RANK_DECIMALS)[:, None]).sum(axis=1)
    for r in np.nonzero((kth > 0) & (near > k))[0]:
        key = np.round(raw[r], RANK_DECIMALS)
        cut = -np.partition(-key, k - 1)[k - 1]
        above = np.nonzero(key > cut)[0]
        part[r] = np.concatenate([above, np.nonzero(key == cut)[0][: k - above.size]])
        val[r] = raw[r, part[r]]
    return part + lo, val


def topk_rows(model: SaeModel, x: np.ndarray, k: int,
              work_bytes: int = DEFAULT_WORK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of ``x``: feature ids and ReLU values of the top ``k`` (all
    features without a cut), by (value desc, id asc), and the k-th largest
    value (0 without a cut or with fewer positive ones)."""
    cut = 0 < k < model.dict_size
    width = k if cut else model.dict_size
    if not len(x):
        return np.zeros((0, width), np.int64), np.zeros((0, width)), np.zeros(0)
    ids, values = [], []
    for s, e in _sub_batches(len(x), 3 * (model.widest() + (width if len(model.blocks) > 1 else 0)), work_bytes):
        idx = val = None
        for b in model.blocks:
            raw = x[s:e] @ model.enc(b).T
            np.maximum(raw, 0.0, out=raw)
            i, v = _block_topk(raw, width, b.lo)
            if idx is not None:
                i, v = np.concatenate([idx, i], axis=1), np.concatenate([val, v], axis=1)
                if cut and i.shape[1] > width:
                    i, v = (m[:, :width] for m in _rowwise_sorted(i, v))
            idx, val = i, v
        idx, val = _rowwise_sorted(idx, val)
        ids.append(idx)
        values.append(val)
    idx, val = np.concatenate(ids), np.concatenate(values)
    return idx, val, val[:, k - 1].copy() if cut else np.zeros(len(x))


def decoded_rows(model: SaeModel, idx: np.ndarray, val: np.ndarray,
                 work_bytes: int = DEFAULT_WORK_BYTES) -> np.ndarray:
    """``sum val * dec[idx]`` of each row; only the decoder rows named are
    read (``val`` 0 marks unused places)."""
    out = np.zeros((len(idx), model.input_dim))
    if idx.shape[1]:
        safe = np.where(val != 0, idx, 0)
        for s, e in _sub_batches(len(idx), idx.shape[1] * model.input_dim, work_bytes):
            out[s:e] = np.matmul(val[s:e, None, :], model.gather_dec(safe[s:e]))[:, 0, :]
    return out


def _vectors(rows: np.ndarray) -> pa.ListArray:
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, max(dim, 1), dtype=np.int32)[:n + 1], pa.int32()),
                                    pa.array(rows.reshape(-1), pa.float64()))


def _sub_batches(n: int, width: int, work_bytes: int):
    step = max(1, int(work_bytes // max(1, width * 8)))
    for s in range(0, n, step):
        yield s, min(n, s + step)


# ---------------------------------------------------------------------------
# D1 / J3 + P8: raw activation statistics per row
# ---------------------------------------------------------------------------

def raw_activation_stats(df: DataFrame, model: SaeModel, vec_col: str = "embedding",
                         eps: float = FIRE_EPS,
                         work_bytes: int = DEFAULT_WORK_BYTES) -> DataFrame:
    """Per row: ``n_fired`` (features with |relu| > eps), ``raw_sum`` and
    ``raw_max`` of the ReLU activations over the whole dictionary."""
    in_names = list(df.columns)
    out_fields = list(df.schema.fields) + [
        T.StructField("n_fired", T.LongType()),
        T.StructField("raw_sum", T.DoubleType()),
        T.StructField("raw_max", T.DoubleType()),
    ]

    def run(batches):
        for rb in batches:
            x, valid = _matrix(rb.column(vec_col), model.input_dim)
            n = rb.num_rows
            nf, sm, mx = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            for s, e in _sub_batches(n, 2 * model.widest(), work_bytes):
                for b in model.blocks:
                    raw = np.maximum(x[s:e] @ model.enc(b).T, 0.0)
                    nf[s:e] += (raw > eps).sum(axis=1)
                    sm[s:e] += raw.sum(axis=1)
                    np.maximum(mx[s:e], raw.max(axis=1), out=mx[s:e])
            nf[~valid] = 0
            yield pa.RecordBatch.from_arrays(
                [rb.column(c) for c in in_names] + [pa.array(nf), pa.array(sm), pa.array(mx)],
                names=[f.name for f in out_fields])

    return df.mapInArrow(run, T.StructType(out_fields))


# ---------------------------------------------------------------------------
# A3: firing counts per (language, feature)
# ---------------------------------------------------------------------------

def firing_counts(df: DataFrame, model: SaeModel, language_col: str = "language",
                  vec_col: str = "embedding", eps: float = FIRE_EPS,
                  work_bytes: int = DEFAULT_WORK_BYTES) -> DataFrame:
    """``(language, feature, n)``: rows of each language in which the feature
    fires before the top-k cut (|relu(x . enc)| > eps).

    One scan for any number of blocks, with the parallelism it has.  A task
    counts in one vector per language (sent early when they reach
    ``HELD_BYTES``) and sends them by feature range; ranges are folded in two
    levels (``partials``).  Rows with a null or wrong-size vector count for
    nothing.
    """
    lang_type = df.schema[language_col].dataType
    lang_arrow = to_arrow_type(lang_type)
    src = df.select(F.col(language_col).alias("language"), F.col(vec_col).alias("_v"))
    size = model.dict_size
    spans = list(ranges(size))

    def emit(totals: dict):
        for key, counts in totals.items():
            some = [(r, counts[lo:hi]) for r, lo, hi in spans if counts[lo:hi].any()]
            if some:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(some), lang_arrow), pa.array([r for r, _ in some], pa.int32()),
                     pa.array([v.tobytes() for _, v in some], pa.binary())], names=["language", "range", "blob"])

    def count(batches):
        totals: dict = {}
        for rb in batches:
            x, valid = _matrix(rb.column("_v"), model.input_dim)
            coded = pc.dictionary_encode(rb.column("language"))
            keys = coded.dictionary.to_pylist() + [None]
            codes = np.where(valid, pc.fill_null(coded.indices, len(keys) - 1).to_numpy(zero_copy_only=False), -1)
            order = np.argsort(codes, kind="stable")[np.count_nonzero(codes < 0):]
            x, codes = x[order], codes[order]
            for s, e in _sub_batches(len(x), 2 * model.widest(), work_bytes):
                there, first = np.unique(codes[s:e], return_index=True)
                for c in there:
                    totals.setdefault(keys[c], np.zeros(size, np.int64))
                for b in model.blocks:
                    fired = (x[s:e] @ model.enc(b).T > eps).view(np.uint8)
                    sums = np.add.reduceat(fired, first, axis=0, dtype=np.int64)
                    for c, n in zip(there, sums):
                        totals[keys[c]][b.lo:b.hi] += n
            if len(totals) * size * 8 > HELD_BYTES:
                yield from emit(totals)
                totals = {}
        yield from emit(totals)

    def add(key, a, b):
        a += b
        return a

    def unpack(batches):
        for (language, r), counts in fold_sorted(batches, ["language", "range"], add, "<i8"):
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(at), lang_arrow), pa.array((at + spans[r][1]).astype(np.int32)),
                 pa.array(counts[at])], names=["language", "feature", "n"])

    parts = src.mapInArrow(count, T.StructType([T.StructField("language", lang_type),
                                                T.StructField("range", T.IntegerType()),
                                                T.StructField("blob", T.BinaryType())]))
    return gathered(parts, ["language", "range"], add, "<i8", wide=many_tasks(src)).mapInArrow(
        unpack, T.StructType([T.StructField("language", lang_type), T.StructField("feature", T.IntegerType()),
                              T.StructField("n", T.LongType())]))


# ---------------------------------------------------------------------------
# Top-k encode, mask, decode
# ---------------------------------------------------------------------------

def _mask_vector(model: SaeModel, mask_features) -> np.ndarray | None:
    if mask_features is None:
        return None
    m = np.zeros(model.dict_size, dtype=bool)
    ids = np.asarray(list(mask_features), dtype=np.int64)
    if ids.size:
        if ids.min() < 0 or ids.max() >= model.dict_size:
            raise ValueError("mask feature outside the dictionary")
        m[ids] = True
    return m


def encode_topk(df: DataFrame, model: SaeModel, vec_col: str = "embedding",
                k: int | None = None, mask_features=None, ranks: bool = False,
                work_bytes: int = DEFAULT_WORK_BYTES) -> DataFrame:
    """Add ``feat_idx ARRAY<INT>``, ``feat_val ARRAY<DOUBLE>`` (the positive
    top-k activations, sorted by value desc then id) and ``kth_value`` (the
    k-th largest ReLU value, 0 without a top-k cut or with fewer positives).

    ``mask_features`` (a bounded set of feature ids, at most the dictionary)
    removes those features after the cut (P10: ``features * ~mask``); with
    ``ranks`` the column ``feat_rank ARRAY<INT>`` says which rank a feature
    had before that.
    """
    return _coded(df, model, vec_col, k, mask_features, work_bytes, ranks=ranks, features=True)


def reconstruct(df: DataFrame, model: SaeModel, vec_col: str = "embedding", k: int | None = None,
                mask_features=None, work_bytes: int = DEFAULT_WORK_BYTES) -> DataFrame:
    """D5 in one pass: ``recon ARRAY<DOUBLE>`` of the top-k features and
    ``recon_masked`` of those that the mask leaves."""
    return _coded(df, model, vec_col, k, mask_features, work_bytes, recon=True, masked=True)


def reconstruct_masked(df: DataFrame, model: SaeModel, vec_col: str = "embedding", k: int | None = None,
                       mask_features=None, work_bytes: int = DEFAULT_WORK_BYTES) -> DataFrame:
    """Only ``recon_masked``: language-agnostic vectors for retrieval."""
    return _coded(df, model, vec_col, k, mask_features, work_bytes, masked=True)


def _coded(df: DataFrame, model: SaeModel, vec_col: str, k: int | None, mask_features, work_bytes: int,
           features: bool = False, ranks: bool = False, recon: bool = False, masked: bool = False) -> DataFrame:
    """One node: encode, cut, mask, decode, whichever columns are asked for."""
    k = model.sparsity if k is None else int(k)
    mask = _mask_vector(model, mask_features)
    added = []
    if features:
        added += [T.StructField(FEAT_IDX, T.ArrayType(T.IntegerType())),
                  T.StructField(FEAT_VAL, T.ArrayType(T.DoubleType())), T.StructField(KTH, T.DoubleType())]
    if ranks:
        added.append(T.StructField(FEAT_RANK, T.ArrayType(T.IntegerType())))
    if recon:
        added.append(T.StructField(RECON, T.ArrayType(T.DoubleType())))
    if masked:
        added.append(T.StructField(RECON_MASKED, T.ArrayType(T.DoubleType())))
    base = [f for f in df.schema.fields if f.name not in {a.name for a in added}]
    names = [f.name for f in [*base, *added]]

    def run(batches):
        for rb in batches:
            x, valid = _matrix(rb.column(vec_col), model.input_dim)
            rows = []
            # as many rows at a time as their features and vectors fit
            width = (k if 0 < k < model.dict_size else model.dict_size) * 4 + model.input_dim * 3
            for s, e in _sub_batches(rb.num_rows, width, work_bytes):
                idx, val, kth = topk_rows(model, x[s:e], k, work_bytes)
                keep = (val > 0) & valid[s:e, None]
                left = keep if mask is None else keep & ~mask[idx]
                cols = [rb.column(f.name).slice(s, e - s) for f in base]
                if features:
                    cols += [_list(idx.astype(np.int32), left, pa.int32()), _list(val, left, pa.float64()),
                             pa.array(np.where(valid[s:e], kth, 0.0))]
                if ranks:
                    place = np.broadcast_to(np.arange(1, idx.shape[1] + 1, dtype=np.int32), idx.shape)
                    cols.append(_list(place, left, pa.int32()))
                if recon:
                    cols.append(_vectors(decoded_rows(model, idx, np.where(keep, val, 0.0), work_bytes)))
                if masked:
                    cols.append(_vectors(decoded_rows(model, idx, np.where(left, val, 0.0), work_bytes)))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, T.StructType([*base, *added]))


def decode(df: DataFrame, model: SaeModel, out_col: str = RECON,
           work_bytes: int = DEFAULT_WORK_BYTES) -> DataFrame:
    """Add ``recon ARRAY<DOUBLE>`` = sum of ``value_f * dec_f`` over the row's
    sparse features (``feat_idx``/``feat_val``), for features stored before;
    ``reconstruct`` goes from vectors in one pass."""
    base = [f for f in df.schema.fields if f.name != out_col]

    def run(batches):
        for rb in batches:
            idx, _ = _ragged(rb.column(FEAT_IDX), 0, np.int64)
            val, _ = _ragged(rb.column(FEAT_VAL), 0.0, np.float64)
            yield pa.RecordBatch.from_arrays(
                [rb.column(f.name) for f in base] + [_vectors(decoded_rows(model, idx, val, work_bytes))],
                names=[f.name for f in base] + [out_col])

    return df.mapInArrow(run, T.StructType([*base, T.StructField(out_col, T.ArrayType(T.DoubleType()))]))


# ---------------------------------------------------------------------------
# Evaluation metrics from sufficient statistics
# ---------------------------------------------------------------------------

GROUP = "_grp"
SEGMENT_ROWS = 1 << 16      # rows of a group that one task reduces
ROW_SUMS = ("n", "sq", "res", "l1", "l0")
_DONE, _ROWS = -2, -1       # in place of a feature range: finished sums, sums over rows


class GroupSums:
    """Sums over the rows of one group: scalars, the vector sum, and per
    feature the usage estimate and the largest value after the cut."""

    def __init__(self, model: SaeModel):
        self.model = model
        self.rows = np.zeros(len(ROW_SUMS) + model.input_dim)
        self.usage, self.alive = np.zeros(model.dict_size), np.zeros(model.dict_size)

    def add(self, x: np.ndarray, k: int, work_bytes: int) -> None:
        model = self.model
        for s, e in _sub_batches(len(x), 4 * model.widest(), work_bytes):
            part = x[s:e]
            idx, val, kth = topk_rows(model, part, k, work_bytes)
            res = decoded_rows(model, idx, val, work_bytes) - part
            self.rows[:5] += [len(part), (part * part).sum(), (res * res).sum(), val.sum(), (val > 0).sum()]
            self.rows[5:] += part.sum(axis=0)
            np.maximum.at(self.alive, idx[val > 0], val[val > 0])
            for b in model.blocks:
                self.usage[b.lo:b.hi] += usage_estimate(np.maximum(part @ model.enc(b).T, 0.0), kth).sum(axis=0)

    def parts(self):
        yield _ROWS, self.rows
        for r, lo, hi in ranges(self.model.dict_size):
            yield r, np.concatenate([self.usage[lo:hi], self.alive[lo:hi]])

    @staticmethod
    def merge(key, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if key[1] == _ROWS:
            return a + b
        h = len(a) // 2
        return np.concatenate([a[:h] + b[:h], np.maximum(a[h:], b[h:])])


def usage_estimate(raw: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """``sigmoid((raw - kth) * T)``, safe from overflow."""
    z = (raw - kth[:, None]) * USAGE_TEMPERATURE
    small = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, small) / (1.0 + small)


class Finish:
    """Sums of one group, range after range (sums over rows first)."""

    def __init__(self, aux_target: float):
        self.target = aux_target

    def rows(self, v: np.ndarray) -> None:
        self.sums = [*v[:5], float((v[5:] ** 2).sum())]
        self.dead, self.aux = 0.0, 0.0

    def features(self, v: np.ndarray) -> None:
        h = len(v) // 2
        self.dead += float((v[h:] == 0).sum())
        self.aux += float((np.maximum(self.target - v[:h] / self.sums[0], 0.0) ** 2).sum())

    def values(self) -> np.ndarray:
        return np.array([*self.sums, self.dead, self.aux])


def evaluate(df: DataFrame, model: SaeModel, vec_col: str = "embedding",
             group_col: str | None = None, l1_coeff: float = 0.0,
             aux_coeff: float = 0.0, aux_target: float = 0.01, segment_rows: int = SEGMENT_ROWS,
             work_bytes: int = DEFAULT_WORK_BYTES) -> DataFrame:
    """SAE metrics per group (one row per ``group_col`` value, or one row for
    the whole table): n_rows, mse_loss, fvu, l0, dead_features, l1_mean,
    l1_loss, aux_loss, loss.

    The whole table is reduced in its own scan: a task sends its sums by
    feature range, which are folded in two levels.  Groups are brought
    together first (rows of a group of more than ``segment_rows`` in several
    segments) and come sorted, so a task holds the sums of one group at a
    time, however many there are; a group of one segment is finished there
    and sends one row.
    """
    dim, dsz, k = model.input_dim, model.dict_size, model.sparsity
    if group_col:
        src = df.select(F.col(group_col).cast("long").alias(GROUP), F.col(vec_col).alias("_v"))
        sizes = src.groupBy(F.col(GROUP).alias("_g")).agg(
            F.ceil(F.count(F.lit(1)) / F.lit(segment_rows)).cast("int").alias("_segments"))
        rows = src.join(sizes, F.col(GROUP).eqNullSafe(F.col("_g"))).select(
            GROUP, "_segments", F.pmod(F.xxhash64("_v"), F.col("_segments")).cast("int").alias("_segment"), "_v")
        rows = rows.repartition(GROUP, "_segment").sortWithinPartitions(GROUP, "_segment")
    else:
        src = df.select(F.lit(0).cast("long").alias(GROUP), F.col(vec_col).alias("_v"))
        rows = src.select(GROUP, F.lit(0).alias("_segments"), F.lit(0).alias("_segment"), "_v")
    finish = Finish(aux_target)

    def send(group, segments, sums):
        if segments == 1:
            finish.rows(sums.rows)
            for r, v in sums.parts():
                if r != _ROWS:
                    finish.features(v)
            parts = [(_DONE, finish.values())]
        else:
            parts = list(sums.parts())
        return pa.RecordBatch.from_arrays(
            [pa.array([group] * len(parts), pa.int64()), pa.array([r for r, _ in parts], pa.int32()),
             pa.array([v.tobytes() for _, v in parts], pa.binary())], names=[GROUP, "range", "blob"])

    def reduce(batches):
        now, sums = None, None
        for rb in batches:
            x, valid = _matrix(rb.column("_v"), dim)
            keys = list(zip(*(rb.column(c).to_pylist() for c in (GROUP, "_segments", "_segment"))))
            cuts = [i for i, key in enumerate(keys) if i == 0 or key != keys[i - 1]] + [len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if keys[i] != now:
                    if sums is not None and sums.rows[0]:
                        yield send(now[0], now[1], sums)
                    now, sums = keys[i], GroupSums(model)
                sums.add(x[i:j][valid[i:j]], k, work_bytes)
        if sums is not None and sums.rows[0]:
            yield send(now[0], now[1], sums)

    names = [*ROW_SUMS, "xsum_sq", "n_dead", "aux_sum"]

    def close(batches):
        done: list = []
        group = None
        for (g, r), v in fold_sorted(batches, [GROUP, "range"], GroupSums.merge):
            if r == _DONE:
                done.append((g, v))
            elif r == _ROWS:
                if group is not None:
                    done.append((group[0], finish.values()))
                group = (g,)
                finish.rows(v)
            else:
                finish.features(v)
        if group is not None:
            done.append((group[0], finish.values()))
        if done:
            values = np.array([v for _, v in done])
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in done], pa.int64()), *(pa.array(c) for c in values.T)], names=[GROUP, *names])

    parts = rows.mapInArrow(reduce, T.StructType([T.StructField(GROUP, T.LongType()),
                                                  T.StructField("range", T.IntegerType()),
                                                  T.StructField("blob", T.BinaryType())]))
    wide = not group_col and many_tasks(src)
    m = gathered(parts, [GROUP, "range"], GroupSums.merge, wide=wide, by=[GROUP]).mapInArrow(
        close, T.StructType([T.StructField(GROUP, T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names)]))
    mse = F.col("res") / (F.col("n") * dim)
    var = (F.col("sq") - F.col("xsum_sq") / F.col("n")) / (F.col("n") * dim)
    fvu = F.lit(1.0) - ((var - mse) / (var + FVU_EPS))
    aux = F.col("aux_sum") / dsz * aux_coeff
    l1_mean = F.col("l1") / (F.col("n") * dsz)
    out = m.select(
        F.col(GROUP).alias(group_col or GROUP),
        F.col("n").cast("long").alias("n_rows"),
        mse.alias("mse_loss"), fvu.alias("fvu"),
        (F.col("l0") / F.col("n")).alias("l0"),
        (F.col("n_dead") / dsz).alias("dead_features"),
        l1_mean.alias("l1_mean"), (l1_mean * l1_coeff).alias("l1_loss"),
        aux.alias("aux_loss"),
        (mse + l1_mean * l1_coeff + aux).alias("loss"),
    )
    return out if group_col else out.drop(GROUP)


def batch_weighted(per_batch: DataFrame,
                   metrics=("mse_loss", "fvu", "dead_features", "l0", "loss")) -> DataFrame:
    """Per-batch metrics weighted by batch size, summed, divided by the
    total (the validation form; it depends on the batch split)."""
    return per_batch.agg(
        F.sum("n_rows").alias("n_rows"),
        *[(F.sum(F.col(c) * F.col("n_rows")) / F.sum("n_rows")).alias(c) for c in metrics])


def dimension_check(df: DataFrame, expected: int, vec_col: str = "embedding") -> DataFrame:
    """One row: rows, smallest and largest vector size, and the rows
    that are null or whose size differs from ``expected`` (must be 0)."""
    size = F.size(vec_col)
    ok = F.col(vec_col).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.min(F.when(ok, size)).alias("min_dim"),
                  F.max(F.when(ok, size)).alias("max_dim"),
                  F.count_if(~ok | (size != F.lit(expected))).alias("n_bad"))


def assert_dimension(df: DataFrame, dim: int, vec_col: str = "embedding") -> None:
    """Fail when any vector is null or of another size than ``dim``."""
    bad = df.filter(F.col(vec_col).isNull() | (F.size(vec_col) != dim)).limit(1).count()
    if bad:
        raise ValueError(f"vectors of a size other than {dim} in {vec_col}")
