"""Operator 6: best-fit packing of documents into token sequences.

Linear grouping scheme (de la Vega and Lueker): lengths above ``SMALL_PART``
of the capacity are sorted and cut into ``GROUPS`` groups of equal
cardinality, each rounded up to its longest length; the cheapest mix of
configurations of those few sizes is found by column generation; actual
documents take the slots of their group; short documents then go, longest
first, to the sequence with the least room that still fits.

The optimiser sees only the histogram of lengths (at most ``capacity`` rows,
whatever the corpus), so it is bounded and runs on the driver; equal
sequences are handled as intervals.  Its plan says, for the r-th document of
each length, its sequence and offset; it has at most (lengths x intervals)
segments, bounded by the capacity alone, and is broadcast.  Ranks inside a
length come from the encoding pass itself (a counter per length and task)
plus prefix sums over tasks, so a length that holds a third of all documents
is never gathered in one task.

Defined cases: null or empty text has just the end id; only documents longer
than the capacity are cut, into full pieces and a last one; equal ids and
repeated rows are packed each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm.stages import staged
from glossa.llm.tokens import encoder, tokenizer_path

CAPACITY = 4096
SMALL_PART = 8        # lengths above capacity / 8 are large
GROUPS = 24
MAX_COLUMNS = 400     # of column generation; it usually ends before
ENCODE_ROWS = 256

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"
PACKED = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
          "sequence_id long, offset long")


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text; one row per piece, with its number ``nth`` among
    the pieces of the same length of the same task ``part``."""
    def encode(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer, "word")
        end = np.asarray([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in (b.slice(at, ENCODE_ROWS) for b in batches for at in range(0, b.num_rows, ENCODE_ROWS)):
            keys = batch.column(0).to_pylist()
            out = []
            for key, ids in zip(keys, enc.encode(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for piece, at in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - at)
                    out.append((key, piece, at, length,
                                zlib.crc32(ids[4 * at:4 * (at + length)]), part, int(seen[length])))
                    seen[length] += 1
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(),
                                                       pa.int64(), pa.int32(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
        enc.rest()

    return docs.select(F.col(id_col).cast("long").alias("_id"),
                       F.col(text_col).cast("string").alias("_text")).mapInArrow(encode, PIECES)


# --- the plan: lengths with counts -> segments -------------------------------

def equal_groups(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cut ``(length, count)`` pairs, longest first, into at most ``groups``
    groups of equal cardinality (groups of one size are merged)."""
    total = sum(c for _, c in lengths)
    if not total:
        return []
    share = -(-total // groups)
    out: list[list[tuple[int, int]]] = [[]]
    room = share
    for length, count in lengths:
        while count:
            if not room:
                out.append([])
                room = share
            take = min(room, count)
            out[-1].append((length, take))
            room -= take
            count -= take
    merged: list[list[tuple[int, int]]] = []
    for g in out:
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1] += g
        else:
            merged.append(g)
    return merged


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of ``sizes`` that fits (knapsack by size)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    small = int(sizes.min())
    for c in range(small, capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        got = best[c - sizes[fits]] + worth[fits]
        k = int(got.argmax())
        best[c], last[c] = best[c - 1], -1
        if got[k] > best[c] + 1e-12:
            best[c], last[c] = got[k], fits[k]
    counts = np.zeros(len(sizes), dtype=np.int64)
    c = capacity
    while c >= small:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations with how often each is used, covering the demand:
    column generation on the relaxed problem, rounded down, the rest by
    first fit decreasing."""
    if not sizes:
        return []
    s, n = np.asarray(sizes, np.int64), np.asarray(demand, np.int64)
    k = len(s)
    basis = np.diag(capacity // s).astype(float)
    x = n / (capacity // s)
    for _ in range(MAX_COLUMNS):
        duals = np.linalg.solve(basis.T, np.ones(k))
        value, column = _best_configuration(s, np.maximum(duals, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        t = ratio[out]
        x = x - t * step
        x[out] = t
        basis[:, out] = column
    used = [(basis[:, j].round().astype(np.int64), int(np.floor(x[j] + 1e-9))) for j in range(k)]
    used = [(c, q) for c, q in used if q > 0]
    left = n - sum((c * q for c, q in used), np.zeros(k, dtype=np.int64))
    left = np.maximum(left, 0)
    while left.any():
        column, room = np.zeros(k, dtype=np.int64), capacity
        for g in range(k):
            take = min(int(left[g]), room // int(s[g]))
            column[g] += take
            room -= take * int(s[g])
        many = max(1, int(min(left[g] // column[g] for g in range(k) if column[g])))
        used.append((column, many))
        left = left - column * many
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Segments ``(length, from, n, sequence, per, offset)``: documents
    ``from .. from + n`` of a length go, ``per`` to a sequence, into the
    sequences from ``sequence`` on, the first at ``offset``.  Also the number
    of sequences."""
    lengths = sorted(((int(k), int(v)) for k, v in histogram.items() if v), reverse=True)
    large = [(k, v) for k, v in lengths if k * SMALL_PART > capacity]
    small = [(k, v) for k, v in lengths if k * SMALL_PART <= capacity]
    grouped = equal_groups(large, groups)
    used = configurations([g[0][0] for g in grouped], [sum(c for _, c in g) for g in grouped], capacity)
    taken: dict[int, int] = {}
    segments: list[tuple[int, int, int, int, int, int]] = []
    supply = [[list(x) for x in g] for g in grouped]
    sequences = 0
    rooms: dict[int, list[tuple[int, int]]] = {}      # room -> [(first, many)]
    for column, many in used:
        intervals = [(sequences, many, 0)]             # first, many, filled
        sequences += many
        for g in np.flatnonzero(column):
            for _ in range(int(column[g])):
                nxt = []
                for first, q, filled in intervals:
                    while q and supply[g]:
                        length, count = supply[g][0]
                        take = min(q, count)
                        r = taken.get(length, 0)
                        segments.append((length, r, take, first, 1, filled))
                        taken[length] = r + take
                        nxt.append((first, take, filled + length))
                        first, q = first + take, q - take
                        supply[g][0][1] -= take
                        if not supply[g][0][1]:
                            supply[g].pop(0)
                    if q:
                        nxt.append((first, q, filled))
                intervals = nxt
        for first, q, filled in intervals:
            rooms.setdefault(capacity - filled, []).append((first, q))
    order = sorted(rooms)

    def put(room: int, first: int, q: int) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append((first, q))

    for length, count in small:
        at = 0
        while count:
            i = bisect.bisect_left(order, length)
            if i < len(order):
                room = order[i]
                first, q = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(i)
            else:
                room, first = capacity, sequences
                q = -(-count // (capacity // length))
                sequences += q
            per = room // length
            full = min(q, count // per)
            if full:
                segments.append((length, at, full * per, first, per, capacity - room))
                at, count = at + full * per, count - full * per
                put(room - per * length, first, full)
                first, q = first + full, q - full
            if q and count and count < per:
                segments.append((length, at, count, first, count, capacity - room))
                put(room - count * length, first, 1)
                at, count, first, q = at + count, 0, first + 1, q - 1
            if q:
                put(room, first, q)
    table = np.asarray(sorted(segments), dtype=np.int64).reshape(-1, 6)
    return table, sequences


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Place the rows of a stage table made by ``token_pieces``."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # <= capacity rows
    segments, _ = plan(histogram, capacity, groups)
    shared = spark.sparkContext.broadcast(segments)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = (pieces.join(bases, ["length", "part"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("r")))

    def place(batches):
        seg = shared.value
        key = (seg[:, 0] << 44) | seg[:, 1]
        for b in batches:
            length = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            r = b.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            i = np.searchsorted(key, (length << 44) | r, side="right") - 1
            t, per = r - seg[i, 1], seg[i, 4]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(length), b.column(4),
                 pa.array(seg[i, 3] + t // per), pa.array(seg[i, 5] + (t % per) * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY,
                   groups: int = GROUPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, cut and pack ``docs``; one row per piece."""
    return pack_pieces(staged(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces"),
                       capacity, groups)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))
