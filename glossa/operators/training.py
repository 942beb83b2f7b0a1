"""Dictionary fitting (D7) with the weights as a table.

The state of a fit is a table sharded by feature: ``(feature, enc, dec)``,
the moments of Adam and the gradient gathered so far, arrays of the input
length.  It starts from hash-made weights (a value is a function of seed,
feature and place, the same in any engine with md5; the decoder starts as
the transposed encoder).  A step is a few Spark jobs over one mini-batch:

1. the current weights become weight files (``weights``);
2. with an aux loss, the usage estimate of every feature is summed by feature
   range and becomes a file as well;
3. tasks sum the gradients of MSE + L1 + aux for slices of features; slices
   are sent when a task holds ``HELD_BYTES`` of them and at its end, and are
   folded in two levels (``partials``) into a table ``(feature, g_enc,
   g_dec)``;
4. the state joins the gradients on the feature and takes the Adam update.

The driver sees three sums and the aux loss per step, no weight and no
gradient.  The state of the step before is removed when the next is
written.  Batches are made by a hash of the vector, so a row's batch does
not depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.operators.partials import HELD_BYTES, fold_sorted, gathered, many_tasks, ranges
from glossa.operators.sae import (
    DEFAULT_WORK_BYTES, SaeModel, _matrix, _sub_batches, decoded_rows, load_model, topk_rows, usage_estimate,
    USAGE_TEMPERATURE,
)
from glossa.session import materialize, remove_table

# Adam as commonly set.
BETA_1, BETA_2, ADAM_EPS = 0.9, 0.999, 1e-8
SLICE_BYTES = 1 << 20       # of one feature slice's gradients

_VECTOR = T.ArrayType(T.DoubleType())
_STATE = T.StructType([T.StructField("feature", T.IntegerType()), *(
    T.StructField(c, _VECTOR) for c in ("enc", "dec", "m_enc", "v_enc", "m_dec", "v_dec", "a_enc", "a_dec"))])
_GRADS = T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("g_enc", _VECTOR),
                       T.StructField("g_dec", _VECTOR)])
_PART = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("blob", T.BinaryType())])


@dataclass
class FitResult:
    """Fitted dictionary (a table of atoms) and the losses of its steps."""

    atoms: DataFrame
    history: list = field(default_factory=list)


def hash_weights(spark: SparkSession, dict_size: int, dim: int, seed: int = 42) -> DataFrame:
    """``(feature, enc, dec)``: uniform in +-1/sqrt(dim), from the first 8 hex
    digits of ``md5(seed:feature:place)``; dec = enc."""
    def value(j):
        digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("feature").cast("string"),
                                               j.cast("string"))), 1, 8)
        u = F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
        return (u * 2 - 1) * F.lit(1.0 / np.sqrt(dim))
    rows = spark.range(dict_size).select(F.col("id").cast("int").alias("feature"))
    enc = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value)
    return rows.select("feature", enc.alias("enc")).withColumn("dec", F.col("enc"))


def _add(key, a, b):
    return a + b


def usage_sums(batch: DataFrame, model: SaeModel, vec_col: str,
               work_bytes: int = DEFAULT_WORK_BYTES) -> DataFrame:
    """``(feature, value)``: sums of the usage estimate over a batch; feature
    -1 holds the number of usable rows."""
    spans = list(ranges(model.dict_size))

    def count(batches):
        usage, n = np.zeros(model.dict_size), 0
        for rb in batches:
            x, valid = _matrix(rb.column(0), model.input_dim)
            x = x[valid]
            n += len(x)
            for s, e in _sub_batches(len(x), 4 * model.widest(), work_bytes):
                _, _, kth = topk_rows(model, x[s:e], model.sparsity, work_bytes)
                for b in model.blocks:
                    usage[b.lo:b.hi] += usage_estimate(np.maximum(x[s:e] @ model.enc(b).T, 0.0), kth).sum(axis=0)
        parts = [(-1, np.array([float(n)]))] + [(r, usage[lo:hi]) for r, lo, hi in spans]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r for r, _ in parts], pa.int32()), pa.array([v.tobytes() for _, v in parts], pa.binary())],
            names=["range", "blob"])

    def unpack(batches):
        for (r,), v in fold_sorted(batches, ["range"], _add):
            ids = np.array([-1]) if r < 0 else np.arange(spans[r][1], spans[r][2])
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(v)], names=["feature", "value"])

    src = batch.select(vec_col)
    return gathered(src.mapInArrow(count, _PART), ["range"], _add, wide=many_tasks(src)).mapInArrow(
        unpack, "feature int, value double")


class _Slices:
    """Gradients of feature slices that a task holds."""

    def __init__(self, model: SaeModel):
        self.model = model
        self.width = slice_width(model.input_dim)
        self.held: dict[int, np.ndarray] = {}

    def add(self, lo: int, hi: int, g_enc: np.ndarray | None, g_dec: np.ndarray | None) -> None:
        """Add gradients of the features ``lo..hi-1``."""
        for r in range(lo // self.width, (hi - 1) // self.width + 1):
            a, b = max(lo, r * self.width), min(hi, (r + 1) * self.width)
            if r not in self.held:
                size = min(self.width, self.model.dict_size - r * self.width)
                self.held[r] = np.zeros((2, size, self.model.input_dim))
            at = slice(a - r * self.width, b - r * self.width)
            for k, g in enumerate((g_enc, g_dec)):
                if g is not None:
                    self.held[r][k, at] += g[a - lo:b - lo]

    def full(self) -> bool:
        return sum(v.nbytes for v in self.held.values()) > HELD_BYTES

    def send(self) -> list[tuple[int, bytes]]:
        out = [(r, v.tobytes()) for r, v in sorted(self.held.items()) if v.any()]
        self.held = {}
        return out


def slice_width(dim: int) -> int:
    return max(1, SLICE_BYTES // (16 * dim))


def gradients(batch: DataFrame, model: SaeModel, vec_col: str = "embedding", l1_coeff: float = 0.0,
              aux_coeff: float = 0.0, aux_target: float = 0.01, usage: SaeModel | None = None, n_rows: float = 1.0,
              work_bytes: int = DEFAULT_WORK_BYTES) -> DataFrame:
    """``(feature, g_enc, g_dec)`` summed over the rows of a batch, to be
    divided by their number; features without a gradient are absent.  Feature
    -1 holds ``[rows, sum of squared residuals, sum of |features|]``.
    ``usage`` holds the usage sums as a file of one value per feature, over
    ``n_rows`` rows."""
    dim, size, k = model.input_dim, model.dict_size, model.sparsity
    cut = 0 < k < size

    def run(batches):
        held = _Slices(model)
        n, sq, l1 = 0, 0.0, 0.0
        for rb in batches:
            x, valid = _matrix(rb.column(0), dim)
            x = x[valid]
            n += len(x)
            for s, e in _sub_batches(len(x), 6 * model.widest() + 4 * dim, work_bytes):
                part = x[s:e]
                idx, val, kth = topk_rows(model, part, k, work_bytes)
                res = decoded_rows(model, idx, val, work_bytes) - part
                sq += float((res * res).sum())
                l1 += float(val.sum())
                g_recon = res * (2.0 / dim)
                for b in model.blocks:
                    enc, dec = model.enc(b), model.dec(b)
                    z = part @ enc.T
                    raw = np.maximum(z, 0.0)
                    f = np.zeros_like(raw)
                    here = (idx >= b.lo) & (idx < b.hi) & (val > 0)
                    f[np.nonzero(here)[0], idx[here] - b.lo] = val[here]
                    g_f = g_recon @ dec.T
                    if l1_coeff:
                        g_f = g_f + l1_coeff / size * (f > 0)
                    g_z = np.where(f > 0, g_f, 0.0) if cut else g_f * (z > 0)
                    if aux_coeff:
                        share = usage.enc(usage.blocks[model.blocks.index(b)])[:, 0] / n_rows
                        slope = -2.0 * aux_coeff / size * np.maximum(aux_target - share, 0.0)
                        sig = usage_estimate(raw, kth)
                        g_z = g_z + slope * sig * (1.0 - sig) * USAGE_TEMPERATURE * (z > 0)
                    held.add(b.lo, b.hi, g_z.T @ part, f.T @ g_recon)
                    if held.full():
                        yield _send(held.send())
        yield _send([(-1, np.array([float(n), sq, l1]).tobytes()), *held.send()])

    width = slice_width(dim)

    def unpack(batches):
        for (r,), v in fold_sorted(batches, ["range"], _add):
            if r < 0:
                ids, rows = np.array([-1]), [v[None], np.zeros((1, 3))]
            else:
                both = v.reshape(2, -1, dim)
                some = np.nonzero(both.any(axis=(0, 2)))[0]
                ids, rows = some + r * width, [both[0, some], both[1, some]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.astype(np.int32)), *(_lists(m) for m in rows)], names=_GRADS.names)

    src = batch.select(vec_col)
    return gathered(src.mapInArrow(run, _PART), ["range"], _add, wide=many_tasks(src)).mapInArrow(unpack, _GRADS)


def _send(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int32()),
                                       pa.array([v for _, v in parts], pa.binary())], names=["range", "blob"])


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d),
                                    pa.array(np.ascontiguousarray(rows).reshape(-1)))


def adam_update(state: DataFrame, grads: DataFrame, scale: float, lr: float, step: int | None) -> DataFrame:
    """The state joined with the gradients on the feature: ``scale`` times
    them is gathered; with ``step`` (from 1) the gathered gradient is applied
    by Adam and starts again from zero."""
    joined = state.join(grads.filter("feature >= 0"), "feature", "left").select(*state.columns, "g_enc", "g_dec")

    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            enc, _ = _matrix(rb.column("enc"), dim := len(rb.column("enc")[0].as_py()))
            at = {c: _matrix(rb.column(c), dim)[0] for c in rb.schema.names if c not in ("feature", "enc")}
            out = {"enc": enc.copy(), "dec": at["dec"].copy()}
            for side in ("enc", "dec"):
                g = at[f"a_{side}"] + scale * at[f"g_{side}"]        # absent gradients read as zero
                m, v = at[f"m_{side}"], at[f"v_{side}"]
                if step is not None:
                    m, v = BETA_1 * m + (1 - BETA_1) * g, BETA_2 * v + (1 - BETA_2) * g * g
                    out[side] -= lr * (m / (1 - BETA_1 ** step)) / (np.sqrt(v / (1 - BETA_2 ** step)) + ADAM_EPS)
                    g = np.zeros_like(g)
                out[f"a_{side}"], out[f"m_{side}"], out[f"v_{side}"] = g, m, v
            yield pa.RecordBatch.from_arrays([rb.column("feature"), *(_lists(out[c]) for c in _STATE.names[1:])],
                                             names=_STATE.names)

    return joined.mapInArrow(run, _STATE)


def fit_sae(df: DataFrame, dict_size: int, sparsity: int, steps: int, lr: float = 3e-4,
            vec_col: str = "embedding", l1_coeff: float = 0.0, aux_coeff: float = 0.0,
            aux_target: float = 0.01, batch_fraction: float = 1.0, grad_acc_steps: int = 1,
            seed: int = 42, init: DataFrame | None = None, max_block_bytes: int | None = None,
            work_bytes: int = DEFAULT_WORK_BYTES) -> FitResult:
    """Minimise MSE + L1 + aux by Adam; one optimiser step every
    ``grad_acc_steps`` batches; with ``batch_fraction`` < 1 the rows are cut
    once into ``1 / batch_fraction`` batches, used in turn.  ``init`` is a
    table of atoms to start from.  A batch without a usable vector is passed
    over."""
    spark = df.sparkSession
    dim = df.select(F.max(F.size(vec_col))).first()[0]
    if not dim or dim < 1:
        raise ValueError("no vectors to fit")
    n_batches = max(1, int(round(1.0 / batch_fraction))) if batch_fraction < 1.0 else 1
    data = materialize(df.select(vec_col).withColumn("_b", F.pmod(F.xxhash64(vec_col), F.lit(n_batches)).cast("int")),
                       "sae-batches", partition_by=("_b",))
    start = init if init is not None else hash_weights(spark, dict_size, dim, seed)
    zero = F.transform("enc", lambda x: F.lit(0.0))
    state = materialize(start.select(F.col("feature").cast("int").alias("feature"), "enc", "dec",
                                     *(zero.alias(c) for c in _STATE.names[3:])), "sae-state")
    sizes = {} if max_block_bytes is None else {"max_block_bytes": max_block_bytes}
    history, step = [], 0
    for micro in range(steps * grad_acc_steps):
        batch = data.filter(F.col("_b") == micro % n_batches).select(vec_col)
        model = load_model(state, sparsity, **sizes)
        usage, n, aux = None, 1.0, 0.0
        if aux_coeff:
            sums = materialize(usage_sums(batch, model, vec_col, work_bytes), "sae-usage")
            n = sums.filter("feature = -1").first()["value"]
            if n:
                deficit = F.greatest(F.lit(aux_target) - F.col("value") / F.lit(n), F.lit(0.0))
                aux = aux_coeff * sums.filter("feature >= 0").agg(F.avg(deficit * deficit)).first()[0]
                one = F.array("value")
                usage = load_model(sums.filter("feature >= 0").select("feature", one.alias("enc"), one.alias("dec")), 0,
                                   max_block_bytes=16 * (model.blocks[0].hi - model.blocks[0].lo))
            remove_table(sums)
        if n:
            found = materialize(gradients(batch, model, vec_col, l1_coeff, aux_coeff, aux_target, usage, n, work_bytes),
                                "sae-gradients")
            n, sq, l1 = found.filter("feature = -1").first()["g_enc"]
        if n:
            mse, l1 = sq / (n * dim), l1 / (n * model.dict_size) * l1_coeff
            history.append({"step": len(history) + 1, "n_rows": int(n), "mse_loss": mse, "l1_loss": l1,
                            "aux_loss": aux, "loss": mse + l1 + aux})
            last = (micro + 1) % grad_acc_steps == 0
            step += last
            after = materialize(adam_update(state, found, 1.0 / (n * grad_acc_steps), lr, step if last else None),
                                "sae-state")
            remove_table(state)
            remove_table(found)
            state = after
        model.release()
        if usage is not None:
            usage.release()
    remove_table(data)
    return FitResult(state.select("feature", "enc", "dec"), history)
