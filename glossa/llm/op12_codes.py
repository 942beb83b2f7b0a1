"""Operator 12: vector codes by k-means per part, with norm-of-sum bounds.

A vector's integers are cut into equal parts; each part position has a
codebook of up to 256 entries that starts with the parts of the vectors of
smallest id.  A round assigns every part to its nearest entry (exact integer
distances, ties to the lower index) and moves each entry to the floor of its
parts' mean; a last assignment gives the codes.

Bounds.  The codebooks of all rounds are kept (the history).  A row's state
holds, per part: its entry, the exact distance to it and the round it was
taken in, and for each of ``GROUPS`` groups of entries the distance to the
nearest other entry of the group and the round of that.  In round t a
distance taken in round s is still good up to the net displacement
``|C_t - C_s|`` of the entries concerned.  That is the norm of the sum of
their moves, never more than the sum of the norms which accumulated drifts
would give.  A part whose upper bound is below all its lower bounds is not
looked at; else its own distance is taken anew, and only groups whose bound
does not settle it are rescanned exactly.

Each round is one pass: a task reads rows with their state, writes them with
the new state, and adds one row of integer sums per codebook entry; these
are merged by stages and one summary reaches the driver.  The stage table of
the round before is removed once the next one is written.  Nothing depends
on how rows are dealt to tasks: all sums are integers.

Defined cases: rows without a usable vector are dropped (see ``vectors``);
ids may repeat, be null (last in the order of ids) or tie (then ordered by
their integers); fewer than 256 rows give smaller codebooks; an empty table
gives no rows; a length that the number of parts does not divide, or an
integer beyond 2^23, is an error; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from glossa.llm.blobs import merged
from glossa.llm.spread import attach
from glossa.llm.stages import remove, store, table
from glossa.llm.vectors import floors, kept_vectors, vector_length

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
GROUPS = 8
LARGEST = float(1 << 23)    # of an integer: squared distances of a part stay exact in doubles
SLACK = 1e-6                # relative: bounds are widened by it, then stored as 32-bit floats


def state_type(parts: int, groups: int) -> np.dtype:
    """A row's state: entry, its distance and round, group bounds and rounds."""
    return np.dtype([("a", "u1", (parts,)), ("u", "<f8", (parts,)), ("su", "u1", (parts,)),
                     ("l", "<f4", (parts, groups)), ("sl", "u1", (parts, groups))])


def entry_groups(book: np.ndarray, groups: int) -> list[np.ndarray]:
    """Entries of one codebook in at most ``groups`` groups of near ones
    (index order inside a group); a few means from spread-out seeds."""
    x = book.astype(np.float64)
    seeds = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(seeds) < min(groups, len(x)) and far.max() > 0:
        seeds.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[seeds[-1]]) ** 2).sum(axis=1))
    centres = x[seeds]
    for _ in range(5):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[near == g].mean(axis=0) if (near == g).any() else centres[g] for g in range(len(seeds))])
    return [np.nonzero(near == g)[0] for g in range(len(seeds)) if (near == g).any()]


class Rounds:
    """Codebook history of all parts and what a task derives from it."""

    def __init__(self, history: list[np.ndarray], groups: list[list[np.ndarray]], scan: bool = False):
        self.history, self.groups, self.scan = history, groups, scan
        self.now = len(history) - 1
        self.book = history[-1].astype(np.float64)                    # parts x entries x length
        self.norms = (self.book ** 2).sum(axis=2)
        moves = np.stack([np.sqrt(((self.book - b) ** 2).sum(axis=2)) for b in history])  # round x parts x entries
        self.moves = moves * (1 + SLACK)
        self.most = [np.stack([self.moves[:, p, g].max(axis=1) for g in groups[p]], axis=1)
                     for p in range(len(groups))]                     # per part: round x group
        self.of_entry = []
        for p, gs in enumerate(groups):
            where = np.zeros(self.book.shape[1], np.int64)
            for i, g in enumerate(gs):
                where[g] = i
            self.of_entry.append(where)
        self.distances = 0                                            # taken exactly, for the record

    def assign(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        """New state of rows with integers ``x``; returns the exact squared
        distances (rows x parts) to the entries now assigned, -1 where the
        bounds left a part alone."""
        out = np.full((len(x), len(self.groups)), -1, np.int64)
        width = self.book.shape[2]
        for p in range(len(self.groups)):
            out[:, p] = self._part(p, x[:, p * width:(p + 1) * width].astype(np.float64), state)
        return out

    def _part(self, p: int, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        book, groups, t = self.book[p], self.groups[p], self.now
        a = state["a"][:, p].astype(np.int64)
        k = len(groups)
        low = state["l"][:, p, :k] - self.most[p][state["sl"][:, p, :k], np.arange(k)]
        high = (state["u"][:, p] + self.moves[state["su"][:, p], p, a]) * (1 + SLACK)
        todo = np.nonzero(~(high < low.min(axis=1)))[0] if not self.scan else np.arange(len(x))
        got = np.full(len(x), -1, np.int64)
        if not len(todo):
            return got
        xs, own, low = x[todo], a[todo], low[todo]
        d_own = ((xs - book[own]) ** 2).sum(axis=1)
        self.distances += len(todo)
        need = ~(np.sqrt(d_own)[:, None] * (1 + SLACK) < low) | self.scan
        best, entry = d_own.copy(), own.copy()
        second = np.full((len(todo), k), np.inf)      # nearest entry of a group but the winner, squared
        first_of = np.full((len(todo), k), -1)
        sq = (xs ** 2).sum(axis=1)
        for g, members in enumerate(groups):
            r = np.nonzero(need[:, g])[0]
            if not len(r):
                continue
            self.distances += len(r) * len(members)
            d = sq[r, None] - 2.0 * (xs[r] @ book[members].T) + self.norms[p][members]
            mine = members[None, :] == own[r][:, None]
            d[mine] = np.inf
            at = d.argmin(axis=1)                     # the first of equal ones: the lower index
            least = d[np.arange(len(r)), at]
            d[np.arange(len(r)), at] = np.inf
            second[r, g] = d.min(axis=1)              # without the least one and the row's own entry
            first_of[r, g] = members[at]
            better = (least < best[r]) | ((least == best[r]) & (members[at] < entry[r]))
            best[r[better]] = least[better]
            entry[r[better]] = members[at][better]
            low[r, g] = np.sqrt(least)
        rows = np.arange(len(todo))
        stamp = np.where(need, t, state["sl"][todo][:, p, :k])
        kept = np.where(need, low, state["l"][todo][:, p, :k])
        moved = np.nonzero(entry != own)[0]
        if len(moved):
            new_group, old_group = self.of_entry[p][entry[moved]], self.of_entry[p][own[moved]]
            kept[moved, new_group] = np.sqrt(second[moved, new_group])
            # the entry left behind is now one of the others of its group
            shifted = np.where(need[moved, old_group], kept[moved, old_group], low[moved, old_group])
            kept[moved, old_group] = np.minimum(shifted, np.sqrt(d_own[moved]))
            stamp[moved, old_group] = t
        state["a"][todo, p] = entry
        state["u"][todo, p] = np.sqrt(best)
        state["su"][todo, p] = t
        whole = np.full((len(todo), state["l"].shape[2]), np.inf)
        whole[:, :k] = kept
        fresh = whole * np.where(np.isfinite(whole), 1 - SLACK, 1)
        keep = np.zeros_like(whole, dtype=bool)
        keep[:, :k] = stamp != t
        state["l"][todo, p] = np.where(keep, state["l"][todo, p], fresh)
        marks = np.zeros(whole.shape, np.uint8)
        marks[:, :k] = stamp
        state["sl"][todo, p] = marks
        got[todo] = best[rows].astype(np.int64)
        return got


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a contiguous array."""
    rows = np.ascontiguousarray(rows)
    width = rows.nbytes // max(len(rows), 1)
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()),
                                                               pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _joined(col: pa.Array) -> bytes:
    return b"".join(col.to_pylist())


def _pack(x: np.ndarray) -> np.ndarray:
    """The narrowest integers that hold a batch."""
    most = np.abs(x).max() if x.size else 0
    return x.astype("<i2" if most < 1 << 15 else "<i4")


def _unpack(col: pa.Array, dim: int) -> np.ndarray:
    values = col.to_pylist()
    if len({len(v) for v in values}) <= 1:
        kind = "<i2" if values and len(values[0]) == 2 * dim else "<i4"
        return np.frombuffer(b"".join(values), kind).reshape(len(values), dim).astype(np.int64)
    return np.stack([np.frombuffer(v, "<i2" if len(v) == 2 * dim else "<i4") for v in values]).astype(np.int64)


def add_sums(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, "<i8") + np.frombuffer(b, "<i8")).astype("<i8").tobytes()


def moved_book(book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each entry at the floor of its parts' mean; unused ones stay."""
    used = counts > 0
    return np.where(used[:, :, None], np.floor_divide(sums, np.maximum(counts, 1)[:, :, None]), book)


def book_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def _integers(df: DataFrame, dim: int, scale: float, dtype: np.dtype) -> DataFrame:
    """``(vec_id, label, vec)`` -> rows with their integers and a state in
    which nothing is known yet."""
    fields = to_arrow_schema(df.select("vec_id", "label").schema)

    def run(batches):
        for batch in batches:
            rows, x = kept_vectors(batch.column(2), dim)
            state = np.zeros(len(rows), dtype)
            state["u"] = np.inf
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), _binary(_pack(floors(x, scale, LARGEST))),
                 _binary(state), pa.nulls(len(rows), pa.binary())],
                names=[fields[0].name, fields[1].name, "x", "state", "sums"])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, x binary, state binary, sums binary")


def _round(rows: DataFrame, rounds: Rounds, dim: int, dtype: np.dtype) -> DataFrame:
    """Rows with their new state, and one row of sums per task."""
    parts, entries = rounds.book.shape[:2]
    width = dim // parts
    schema = rows.schema
    kinds = to_arrow_schema(schema)

    def run(batches):
        sums = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        rounds.distances = 0
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpack(batch.column("x"), dim)
            state = np.frombuffer(_joined(batch.column("state")), dtype).copy()
            rounds.assign(x, state)
            seen += len(x)
            for p in range(parts):
                a = state["a"][:, p].astype(np.int64)
                order = np.argsort(a, kind="stable")
                some, first, n = np.unique(a[order], return_index=True, return_counts=True)
                sums[p, some] += np.add.reduceat(x[order, p * width:(p + 1) * width], first, axis=0)
                counts[p, some] += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("x"), _binary(state),
                 pa.nulls(len(x), pa.binary())], names=schema.names)
        if seen:
            blob = np.concatenate([[seen, rounds.distances], counts.reshape(-1), sums.reshape(-1)]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kinds.field("vec_id").type), pa.nulls(1, kinds.field("label").type),
                 pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([blob], pa.binary())], names=schema.names)
    return rows.mapInArrow(run, schema)


def _codes(rows: DataFrame, rounds: Rounds, dim: int, dtype: np.dtype, types: dict) -> DataFrame:
    """The last assignment: code and exact error of every row."""
    parts = rounds.book.shape[0]
    width = dim // parts

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpack(batch.column("x"), dim)
            state = np.frombuffer(_joined(batch.column("state")), dtype).copy()
            rounds.assign(x, state)
            near = np.concatenate([rounds.history[-1][p][state["a"][:, p]] for p in range(parts)], axis=1)
            codes = np.ascontiguousarray(state["a"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes]),
                 pa.array(((x[:, :parts * width] - near) ** 2).sum(axis=1))],
                names=["vec_id", "label", "code", "error"])
    return rows.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
             groups: int = GROUPS, use_bounds: bool = True) -> tuple[DataFrame, list[np.ndarray], list[dict]]:
    """``(vec_id, label, code, error)`` of every kept row, the codebooks of
    all rounds (first to last: parts x entries x length, integers), and per
    round the rows and the exact distances taken."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte per part: 1 to 256 entries")
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    dim = vector_length(source, "vec")
    if not dim:
        return spark.createDataFrame([], f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"), [], []
    if dim % parts:
        raise ValueError(f"{parts} parts do not divide {dim} entries")
    dtype = state_type(parts, groups)
    path, rows = store(_integers(source.withColumn("vec", F.col("vec").cast("array<double>")), dim, scale, dtype), "codes")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), F.hex("x")).limit(entries).select("x").toArrow().column(0)
    start = _unpack(first.combine_chunks() if isinstance(first, pa.ChunkedArray) else first, dim)
    book = np.ascontiguousarray(start.reshape(len(start), parts, dim // parts).transpose(1, 0, 2))
    near = [entry_groups(book[p], groups) for p in range(parts)]
    history, record = [book], []
    for _ in range(rounds):
        before = path
        path, both = store(_round(rows, Rounds(history, near, not use_bounds), dim, dtype), "codes")
        remove(spark, before)
        blob = np.frombuffer(merged(both.filter("sums is not null").select(F.col("sums").alias("blob")), add_sums), "<i8")
        rows = both.filter("sums is null")
        counts = blob[2:2 + book.shape[0] * book.shape[1]].reshape(book.shape[:2])
        record.append({"rows": int(blob[0]), "distances": int(blob[1])})
        book = moved_book(book, blob[2 + counts.size:].reshape(book.shape), counts)
        history.append(book)
    before = path
    _, coded = store(_codes(rows, Rounds(history, near, not use_bounds), dim, dtype, types), "codes")
    remove(spark, before)
    return coded, history, record


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the sum of errors over rows of equal label (nulls
    together); few labels may hold most rows."""
    keyed = coded.withColumn("key", F.struct("label"))
    labels = keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n_rows"))
    return attach(keyed, labels, "key", "n_rows", coded.count()).drop("key")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of ``embeddings``: 4 parts, 256 entries, 4 rounds."""
    coded, history, _ = compress(table(spark, sf_dir, "embeddings"))
    digest = book_digest(history[-1]) if history else ""
    return with_label_error(coded).select("vec_id", "code", "error", "label_error",
                                          F.lit(digest).alias("codebooks_sha256"))
