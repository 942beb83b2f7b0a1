"""Operator 11: whitening by an incremental eigendecomposition.

The fit list is every usable vector, as integers ``floor(64 * c) + 1000000``.

1. Incremental spectra.  A task keeps a few spectra (mean, count and
   ``Q diag(lam) Q'`` of the scatter about the mean) and deals its rows to
   them.  A row is one centred rank-one update, ``n / (n + 1) (x - mean)
   (x - mean)'``, solved through the secular equation with deflation
   (``secular``).  Exact integer sums are kept beside.
2. Combination.  Two spectra become one by successive rank-one updates: the
   other's scaled eigenvectors one after another, then the difference of the
   means.  Tasks are combined by stages (``blobs``); one spectrum reaches
   the driver.
3. Rayleigh-Ritz.  One pass projects every centred row (``(n x - S) / n``
   from exact integers) on the basis found, sums the products per task and
   merges the sums; the small problem that is left gives the components to
   double precision.  Another pass measures the covariance of the whitened
   rows, which is what ``identity_error`` reports.

Memory of a task: a few arrays of length x length x spectra (at most
``LOCKSTEP`` numbers each), one Arrow batch.  What reaches the driver is one
spectrum, whatever the number of rows.

Defined cases: rows without a usable vector are dropped (see ``vectors``);
repeated rows and ids count each time; components whose variance is zero to
rounding (a constant column, fewer rows than entries) cannot be whitened and
are left out, so equal vectors or a single row give no rows, as an empty
table does; an integer beyond 2^40, or a squared deviation beyond a long, is
an error; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.blobs import BLOB, merged
from glossa.llm.secular import rank_one
from glossa.llm.stages import table
from glossa.llm.vectors import floors, kept_vectors, vector_length

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LOCKSTEP = 1 << 16          # numbers in the largest array of a lock-step update
MIN_ROWS_PER_SPECTRUM = 256
LARGEST = float(1 << 40)


@dataclass
class Spectra:
    """``b`` spectra of ``d`` entries side by side."""

    n: np.ndarray           # (b,)
    mean: np.ndarray        # (b, d)
    lam: np.ndarray         # (b, d) rising
    q: np.ndarray           # (b, d, d)

    @staticmethod
    def nothing(b: int, d: int) -> "Spectra":
        return Spectra(np.zeros(b), np.zeros((b, d)), np.zeros((b, d)), np.broadcast_to(np.eye(d), (b, d, d)).copy())

    def add(self, x: np.ndarray, there: np.ndarray) -> None:
        """One row to each spectrum where ``there``."""
        v = x - self.mean
        rho = np.where(there, self.n / (self.n + 1), 0.0)
        self.lam, self.q = rank_one(self.lam, self.q, v, rho)
        self.n = self.n + there
        self.mean = self.mean + np.where(there[:, None], v / np.maximum(self.n, 1)[:, None], 0.0)

    def join(self, other: "Spectra") -> None:
        """Take in another spectrum beside each: its eigenvectors scaled by
        the roots of their values, then the difference of the means."""
        lam, q = np.maximum(other.lam, 0.0), other.q
        ones = np.ones(len(self.n))
        for i in range(lam.shape[1]):
            self.lam, self.q = rank_one(self.lam, self.q, q[:, :, i], lam[:, i] * ones)
        n = self.n + other.n
        gap = other.mean - self.mean
        self.lam, self.q = rank_one(self.lam, self.q, gap, self.n * other.n / np.maximum(n, 1))
        self.mean = self.mean + gap * (other.n / np.maximum(n, 1))[:, None]
        self.n = n

    def halves(self) -> tuple["Spectra", "Spectra"]:
        h = len(self.n) // 2
        return tuple(Spectra(self.n[s], self.mean[s], self.lam[s], self.q[s]) for s in (slice(0, h), slice(h, 2 * h)))

    def single(self) -> "Spectra":
        """All spectra (a power of two) joined into one."""
        left = self
        while len(left.n) > 1:
            left, right = left.halves()
            left.join(right)
        return left


def _write(s: Spectra, sums: list[int], count: int) -> bytes:
    d = s.mean.shape[1]
    exact = np.array(sums, dtype="<i8").tobytes()
    return struct.pack("<qq", d, count) + exact + s.n.astype("<f8").tobytes() + s.mean.astype("<f8").tobytes() \
        + s.lam.astype("<f8").tobytes() + s.q.astype("<f8").tobytes()


def _read(blob: bytes) -> tuple[Spectra, list[int], int]:
    d, count = struct.unpack_from("<qq", blob)
    sums = np.frombuffer(blob, "<i8", d, 16).tolist()
    v = np.frombuffer(blob, "<f8", offset=16 + 8 * d)
    return Spectra(v[:1], v[1:1 + d].reshape(1, d), v[1 + d:1 + 2 * d].reshape(1, d),
                   v[1 + 2 * d:].reshape(1, d, d)), sums, count


def join_spectra(a: bytes, b: bytes) -> bytes:
    left, s, n = _read(a)
    right, t, m = _read(b)
    left.join(right)
    return _write(left, [x + y for x, y in zip(s, t)], n + m)


def _rows(batch, dim: int, scale: float, shift: int):
    at, x = kept_vectors(batch.column(batch.num_columns - 1), dim)
    return at, floors(x, scale, LARGEST) + shift


def spectra_of(vectors: DataFrame, dim: int, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """One summary per task: the spectrum of its rows, their number and
    exact sums."""
    def run(batches):
        state, sums, count = None, [0] * dim, 0
        for batch in batches:
            _, x = _rows(batch, dim, scale, shift)
            if not len(x):
                continue
            count += len(x)
            sums = [s + int(t) for s, t in zip(sums, x.sum(axis=0))]
            if state is None:
                b = 1
                while b * 2 * dim * dim <= LOCKSTEP and b * 2 * max(MIN_ROWS_PER_SPECTRUM, 4 * dim) <= len(x):
                    b *= 2
                state = Spectra.nothing(b, dim)
            b = len(state.n)
            for lo in range(0, len(x), b):
                part = x[lo:lo + b].astype(np.float64)
                there = np.arange(b) < len(part)
                if len(part) < b:
                    part = np.concatenate([part, np.zeros((b - len(part), dim))])
                state.add(part, there)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"blob": pa.array([_write(state.single(), sums, count)], pa.binary())})
    return vectors.mapInArrow(run, BLOB)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - S / n`` from exact integers, rounded once."""
    most = int(np.abs(x).max()) if x.size else 0
    if n * most < 1 << 62:
        return (x * n - sums) / n
    whole = [[int(v) * n - int(s) for v, s in zip(row, sums)] for row in x]
    return np.array([[v / n for v in row] for row in whole]).reshape(x.shape)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Exact sum over entries of ``(n x - S)^2``."""
    most = int(np.abs(x).max()) if x.size else 0
    if n * most < 1 << 62:
        y = x * n - sums
        if x.shape[1] * float(np.abs(y).max() if y.size else 0) ** 2 < 2 ** 62:
            return (y * y).sum(axis=1)
    out = [sum((int(v) * n - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    if max(out, default=0) >= 1 << 63:
        raise ValueError("a squared deviation does not fit a long")
    return np.array(out, dtype=np.int64)


def add_doubles(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, "<f8") + np.frombuffer(b, "<f8")).tobytes()


def _products(vectors: DataFrame, dim: int, n: int, sums: np.ndarray, basis: np.ndarray, scale, shift) -> np.ndarray:
    """``sum y`` and ``sum y y'`` over all rows, ``y`` the centred row on the
    columns of ``basis``: (1 + m, m)."""
    m = basis.shape[1]

    def run(batches):
        acc = np.zeros((1 + m, m))
        for batch in batches:
            _, x = _rows(batch, dim, scale, shift)
            y = _centred(x, n, sums) @ basis
            acc[0] += y.sum(axis=0)
            acc[1:] += y.T @ y
        yield pa.RecordBatch.from_pydict({"blob": pa.array([acc.tobytes()], pa.binary())})
    return np.frombuffer(merged(vectors.mapInArrow(run, BLOB), add_doubles), "<f8").reshape(1 + m, m)


@dataclass
class Whitening:
    """A fitted whitening: exact list statistics and components by falling
    variance."""

    n: int
    sums: np.ndarray            # (d,) exact
    components: np.ndarray      # (d, k) unit columns
    variances: np.ndarray       # (k,)
    explained: np.ndarray       # (k,)
    identity_error: float
    start: np.ndarray           # eigenvalues / n of the combined incremental spectrum, falling

    @property
    def transform(self) -> np.ndarray:
        return self.components / np.sqrt(self.variances)


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS,
        scale: float = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Fit over all rows; None where no component can be whitened."""
    source = vectors.select(F.col(vec_col).alias("vec"))
    dim = vector_length(source, "vec")
    if not dim:
        return None
    source = source.select(F.col("vec").cast("array<double>").alias("vec"))
    spectrum, sums, n = _read(merged(spectra_of(source, dim, scale, shift), join_spectra, fan_in=16))
    sums = np.array(sums, dtype=np.int64)
    basis, _ = np.linalg.qr(spectrum.q[0][:, ::-1])
    h = _products(source, dim, n, sums, basis, scale, shift)[1:] / n
    value, turn = np.linalg.eigh((h + h.T) / 2)
    value, vector = value[::-1], basis @ turn[:, ::-1]
    trace = float(np.trace(h))
    usable = int((value > max(trace, 0.0) * dim * 64 * np.finfo(float).eps).sum())
    k = min(components, usable)
    if not k:
        return None
    vector = vector[:, :k] / np.linalg.norm(vector[:, :k], axis=0)
    largest = vector[np.abs(vector).argmax(axis=0), np.arange(k)]
    vector = vector * np.where(largest < 0, -1.0, 1.0)
    found = Whitening(n, sums, vector, value[:k], value[:k] / trace, float("nan"), spectrum.lam[0][::-1] / n)
    seen = _products(source, dim, n, sums, found.transform, scale, shift)
    mean = seen[0] / n
    found.identity_error = float(np.abs(seen[1:] / n - np.outer(mean, mean) - np.eye(k)).max())
    return found


def whiten(vectors: DataFrame, w: Whitening, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained,
    identity_error)``: a row per usable vector and component."""
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    dim, k = w.components.shape
    shape = f"vec_id {source.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, " \
            "whitened double, explained double, identity_error double"

    def run(batches):
        for batch in batches:
            at, x = _rows(batch, dim, scale, shift)
            for lo in range(0, len(at), 2048):
                rows, part = at[lo:lo + 2048], x[lo:lo + 2048]
                m = len(rows)
                y = _centred(part, w.n, w.sums) @ w.transform
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column(0).take(pa.array(np.repeat(rows, k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, w.n, np.int64)),
                    "deviation": pa.array(np.repeat(_deviation(part, w.n, w.sums), k)),
                    "whitened": pa.array(y.reshape(-1)),
                    "explained": pa.array(np.tile(w.explained, m)),
                    "identity_error": pa.array(np.full(m * k, w.identity_error))})
    return source.mapInArrow(run, shape)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened ``embeddings``, 32 components."""
    vectors = table(spark, sf_dir, "embeddings")
    w = fit(vectors)
    if w is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double")
    return whiten(vectors, w)
