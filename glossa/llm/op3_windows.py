"""Operator 3: remove repeated passages of ``WINDOW`` words, exactly.

A window of 35 words is repeated if its word sequence starts anywhere else,
in the same document or another.  Three passes over the texts, none of which
shuffles a window that occurs once:

1. *Count-min sketch* of all windows, merged from partition sketches by range
   of cells (see ``ranged``): the task of a range answers every chunk of
   documents with a bit per cell it sent, estimated twice or more.  Merged
   cells only ever overestimate, so no repeated window is lost.
2. *Exact grouping of the estimated ones.*  A task keeps its windows whose
   bits are set in both rows and sends each distinct one once per batch of
   documents, as a 96-bit hash and whether the batch itself has it twice.
   Slices of the hash range are grouped apart; each batch gets back one bit
   per window sent: repeated or not.  A window of a third of all documents
   arrives once per batch, never once per document.
3. *Removal.*  The answer bits meet the batch's texts and the covered words
   go.

The sketch has about ``CELLS_PER_WINDOW`` cells a window and row at every size:
ranges and slices grow in number, not in size.  No worker holds more of it
than the counts of one range or the answers for its own partition, a bit a
window and row, read from the shared folder.

Defined cases: null text has no words; texts under 35 words keep all; null
and repeated ids are kept, one row each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import kernels
from glossa.llm.ranged import RANGE_BITS, Estimates, Sketch, merge_sketch, sketch_for
from glossa.llm.stages import small_batches, staged

WINDOW = 35
CELLS_PER_WINDOW = 4
CHUNK_WINDOWS = 1 << 19
BATCH_BYTES = 16 << 20
BATCH_WINDOWS = 1 << 20
SLICE_WINDOWS = 1 << 20

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _text_windows(column, window: int):
    """Per pack of texts: (first row, words, word hashes, window hashes,
    valid starts)."""
    for pack in kernels.packs(column):
        w = kernels.words(pack)
        h = kernels.word_hashes(pack, w)
        yield pack.first, w, h, kernels.window_hashes(h, window), np.flatnonzero(kernels.window_mask(w, window, len(h)))


def _chunks(batches, window: int, size: int):
    """Cut a partition's rows (text, id, partition) into numbered chunks of
    about ``size`` windows: (partition, number, pieces of 250 rows with
    their ``_text_windows``)."""
    part, seq, held, n = 0, 0, [], 0
    for b in kernels.fixed_rows(batches, 250):
        part = b.column(2)[0].as_py()
        held.append((b, list(_text_windows(b.column(0), window))))
        n += sum(len(starts) for *_, starts in held[-1][1])
        if n >= size:
            yield part, seq, held
            seq, held, n = seq + 1, [], 0
    if held:
        yield part, seq, held


def _windows_of(pieces) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(low[starts] for _, packs in pieces for *_, low, starts in packs)])


class _Batch:
    """Documents of a task until a flush: estimated windows with place."""

    def __init__(self):
        self.docs, self.rows, self.bytes, self.n = [], 0, 0, 0
        self.h0, self.h1, self.doc, self.at = [], [], [], []

    def add(self, pieces, repeated, window) -> None:
        """Take the rows of a chunk; ``repeated`` has a value per window."""
        done = 0
        for b, packs in pieces:
            for first, w, h, low, starts in packs:
                hit = starts[repeated[done:done + len(starts)]]
                done += len(starts)
                if len(hit):
                    d = np.searchsorted(w.first, hit, side="right") - 1
                    self.h0.append(low[hit])
                    self.h1.append((kernels.window_hashes(h, window, 1)[hit] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                    self.doc.append(self.rows + first + d)
                    self.at.append(hit - w.first[d])
                    self.n += len(hit)
            self.docs.append((b.column(0), b.column(1)))
            self.rows += b.num_rows
            self.bytes += b.column(0).nbytes

    def full(self) -> bool:
        return self.bytes >= BATCH_BYTES or self.n >= BATCH_WINDOWS

    def keys(self):
        """Distinct windows in order (two columns), whether each occurs
        twice here, and the windows' places with their key's number."""
        if not self.n:
            z = np.zeros(0, np.int64)
            return z.astype(np.uint64), z.astype(np.uint32), z.astype(bool), z, z, z
        h0, h1 = np.concatenate(self.h0), np.concatenate(self.h1)
        doc, at = np.concatenate(self.doc), np.concatenate(self.at)
        order = np.lexsort((h1, h0))
        h0, h1 = h0[order], h1[order]
        new = np.ones(len(h0), dtype=bool)
        new[1:] = (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])
        number = np.cumsum(new) - 1
        many = np.bincount(number) > 1
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = number
        return h0[new], h1[new], many, doc, at, rank


def _batches(batches, sketch, window, size):
    """Join a partition's chunks into numbered batches of estimated windows;
    the cut depends on the rows alone, so every pass makes the same ones."""
    told, number, held = None, 0, _Batch()
    for part, seq, pieces in _chunks(batches, window, size):
        told = told or Estimates(sketch, part)
        held.add(pieces, told.repeated(seq, _windows_of(pieces)), window)
        if held.full():
            yield (part << 24) | number, held
            number, held = number + 1, _Batch()
    if held.docs:
        yield (part << 24) | number, held


def _slice_bounds(slices: int) -> np.ndarray:
    return (np.arange(slices, dtype=object) * (1 << 64) // slices).astype(np.uint64)


def repeated_windows(docs: DataFrame, sketch: Sketch, window: int, size: int, slices: int) -> DataFrame:
    """One row per (batch, slice): a bit per distinct estimated window of the
    batch in hash order, set if it is repeated; ``n`` windows, ``sum`` of
    their hashes (checked when the bits are used)."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _slice_bounds(slices)

    def send(batches):
        for b, held in _batches(batches, sketch, window, size):
            h0, h1, many, *_ = held.keys()
            cut = np.append(np.searchsorted(h0, bounds), len(h0))
            out = [(b, s, h0[i:j].tobytes(), h1[i:j].tobytes(), many[i:j].tobytes())
                   for s, i, j in zip(range(slices), cut[:-1], cut[1:]) if j > i]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), *[pa.binary()] * 3))],
                    names=["b", "slice", "h0", "h1", "many"])

    def decide(batches):
        def close(rows):
            h0 = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
            h1 = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])
            n = np.concatenate([np.frombuffer(r[4], np.uint8) for r in rows]).astype(np.int64) + 1
            order = np.lexsort((h1, h0))
            a0, a1 = h0[order], h1[order]
            new = np.ones(len(a0), dtype=bool)
            new[1:] = (a0[1:] != a0[:-1]) | (a1[1:] != a1[:-1])
            number = np.cumsum(new) - 1
            total = np.bincount(number, weights=n[order])
            bits = np.empty(len(order), dtype=bool)
            bits[order] = total[number] >= 2
            ends = np.cumsum([len(r[2]) // 8 for r in rows])
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([e - s for s, e in zip([0, *ends], ends)], pa.int64()),
                 pa.array([np.frombuffer(r[2], np.uint64).sum(dtype=np.uint64).astype(np.int64) for r in rows], pa.int64()),
                 pa.array([np.packbits(x).tobytes() for x in np.split(bits, ends[:-1])], pa.binary())],
                names=["b", "slice", "n", "sum", "bits"])

        key, rows = None, []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if r[1] != key and rows:
                    yield close(rows)
                    rows = []
                key = r[1]
                rows.append(r)
        if rows:
            yield close(rows)

    sent = docs.mapInArrow(send, "b long, slice int, h0 binary, h1 binary, many binary")
    return (sent.repartitionById(parts, F.col("slice") % parts).sortWithinPartitions("slice", "b")
            .mapInArrow(decide, "b long, slice int, n long, sum long, bits binary"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """Per document: words, removed words, checksum of the kept text (and the
    text itself when ``with_text``).  ``docs`` should be a stored table: it
    is read four times."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("_id"),
                        F.spark_partition_id().cast("long").alias("_part"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    guess = size // 6 + 1                      # windows, roughly
    chunk = CHUNK_WINDOWS

    def chunks(batches):
        for part, seq, pieces in _chunks(batches, window, chunk):
            yield part, seq, _windows_of(pieces)

    sketch = merge_sketch(texts, chunks, sketch_for(guess, CELLS_PER_WINDOW, bits=RANGE_BITS))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slices = max(parts, guess // SLICE_WINDOWS)
    with small_batches(spark):
        answers = staged(repeated_windows(texts, sketch, window, chunk, slices), "answers")

    def again(batches):
        for b, held in _batches(batches, sketch, window, chunk):
            h0, _, _, doc, at, rank = held.keys()
            order = np.argsort(doc, kind="stable")
            doc, at, rank = doc[order], at[order].astype("<i4"), rank[order].astype("<i4")
            cut = np.searchsorted(doc, np.arange(held.rows + 1))
            check = int(h0.sum(dtype=np.uint64).astype(np.int64))
            lo = 0
            for texts_, ids in held.docs:
                n = len(ids)
                spans = list(zip(cut[lo:lo + n], cut[lo + 1:lo + n + 1]))
                lo += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b] * n, pa.int64()), pa.array([1] * n, pa.int32()), pa.array([0] * n, pa.int32()),
                     pa.array([len(h0)] * n, pa.int64()), pa.array([check] * n, pa.int64()), ids, texts_,
                     pa.array([at[i:j].tobytes() for i, j in spans], pa.binary()),
                     pa.array([rank[i:j].tobytes() for i, j in spans], pa.binary())],
                    names=["b", "kind", "slice", "n", "sum", "id", "text", "at", "bits"])

    def cut_texts(batches):
        now, n, total, bits, known = None, 0, 0, [], None
        for batch in batches:
            out = []
            for b, kind, _, m, s, key, text, at, raw in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if b != now:
                    now, n, total, bits, known = b, 0, 0, [], None
                if kind == 0:
                    n, total = n + m, (total + s) & 0xFFFFFFFFFFFFFFFF
                    bits.append(np.unpackbits(np.frombuffer(raw, np.uint8), count=m))
                    continue
                if known is None:
                    if n != m or total != s & 0xFFFFFFFFFFFFFFFF:
                        raise RuntimeError("the input was not read in the same batches twice; store it first")
                    known = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
                words = (text or "").encode("utf-8").split()
                starts = np.frombuffer(at, "<i4")[known[np.frombuffer(raw, "<i4")]]
                removed = 0
                if len(starts):
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    removed = int(len(words) - keep.sum())
                    total_words, words = len(words), list(compress(words, keep.tolist()))
                else:
                    total_words = len(words)
                kept = b" ".join(words)
                out.append((key, total_words, removed, hashlib.sha256(kept).hexdigest(),
                            *([kept.decode("utf-8")] if with_text else [])))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] if with_text else []))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if with_text else [])])

    schema = "b long, kind int, slice int, n long, sum long, id long, text string, at binary, bits binary"
    null = lambda t: F.lit(None).cast(t)
    told = answers.select("b", F.lit(0).alias("kind"), "slice", "n", "sum", null("long").alias("id"),
                          null("string").alias("text"), null("binary").alias("at"), "bits")
    both = told.unionByName(texts.mapInArrow(again, schema))
    return (both.repartition("b").sortWithinPartitions("b", "kind", "slice")
            .mapInArrow(cut_texts, RESULT + (", text string" if with_text else "")))


def op3_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
