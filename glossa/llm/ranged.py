"""Count-min estimates by cell range: no worker holds a whole sketch.

The cells of a row are cut into ranges of 2**``RANGE_BITS``; their number
follows the items, so the share of single items that pass is the same at
every size.  Three steps:

1. A task cuts its rows into numbered chunks and sends, per chunk, row and
   range, the distinct cells of the chunk's items as packed differences (about
   a byte and a half a cell) and how often each was met in the chunk.
2. The task of a range merges these partition sketches into its counts, one
   range after the other, and answers each chunk for every cell it sent: a bit,
   counted twice or more (``most`` 2), or a byte (counts up to 255).
3. Answers lie in the shared folder by input partition.  The pass that needs
   the estimates cuts the same chunks and reads the bits of its partition.

Merged cells only overestimate, so no repeated item is lost.  Memory of a
worker: one chunk and the answers for one input partition, or the counts of
a range (a byte a cell, 4 MB) and the packed cells sent to it, which are its
share of all items and at least some 100 bytes per chunk.  An item of every
document reaches its range once per chunk.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels
from glossa.llm.sketches import pack_sorted, unpack_sorted
from glossa.llm.stages import filesystem, small_batches, stage_path

RANGE_BITS = 22
RANGES_PER_TASK = 32        # streamed one after the other
PARTS_PER_FOLDER = 8
_SALT = (np.uint64(0), np.uint64(0x5851F42D4C957F2D))

_SENT = "row int, rng int, part long, seq int, cells binary, times binary"
_TOLD = "part long, seq int, row int, rng int, n int, answer binary"


class Sketch(NamedTuple):
    """Cells of a sketch and, once merged, the folder with its answers."""

    ranges: int
    bits: int = RANGE_BITS
    rows: int = 2
    most: int = 2
    path: str = ""

    def keys(self, h: np.ndarray, row: int) -> np.ndarray:
        """Range and cell of each item as one number."""
        if row:
            h = kernels.mix64(h ^ _SALT[row])
        rng = (h >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)
        return (rng << np.uint64(self.bits)) | (h & np.uint64((1 << self.bits) - 1))

    def pack(self, counts: np.ndarray) -> bytes:
        """Counts from 1 to ``most``."""
        import zstandard
        if self.most == 2:
            return np.packbits(counts > 1).tobytes()
        return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.uint8).tobytes())

    def unpack(self, raw: bytes, n: int) -> np.ndarray:
        import zstandard
        if self.most == 2:
            return np.unpackbits(np.frombuffer(raw, np.uint8), count=n) + np.uint8(1)
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)


def sketch_for(items: int, cells_per_item: int, rows: int = 2, most: int = 2, bits: int = RANGE_BITS) -> Sketch:
    """Sketch of that many cells an item in each row."""
    return Sketch(max(1, (items * cells_per_item - 1 >> bits) + 1), bits, rows, most)


def _record_batch(rows: list, schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)],
                                      names=[name for name, _ in fields])


def merge_sketch(df: DataFrame, chunks, sketch: Sketch) -> Sketch:
    """``sketch`` with answers for the items of ``df``.  ``chunks(batches)``
    yields ``(part, seq, items)``: the number of the partition, the number of
    the chunk in it and its items (uint64); it must depend on the rows alone."""
    spark = df.sparkSession
    cells_of = 1 << sketch.bits

    def send(batches):
        for part, seq, h in chunks(batches):
            out = []
            for row in range(sketch.rows):
                key, n = np.unique(sketch.keys(h, row), return_counts=True)
                rng = (key >> np.uint64(sketch.bits)).astype(np.int64)
                cell = (key & np.uint64(cells_of - 1)).astype(np.int64)
                at = np.append(np.flatnonzero(np.diff(rng, prepend=-1)), len(rng)).tolist()
                out += [(row, int(rng[i]), part, seq, pack_sorted(cell[i:j]), sketch.pack(np.minimum(sketch.most, n[i:j])))
                        for i, j in zip(at, at[1:])]
            if out:
                yield _record_batch(out, _SENT)

    def merge(batches):
        def close(row, rng, held):
            counts = np.zeros(cells_of, dtype=np.uint8)
            for _, _, cells, times in held:
                u = unpack_sorted(cells)
                counts[u] = np.minimum(sketch.most, counts[u].astype(np.int16) + sketch.unpack(times, len(u)))
            out, size = [], 0
            for part, seq, cells, _ in held:
                told = counts[unpack_sorted(cells)]
                out.append((part, seq, row, rng, len(told), sketch.pack(told)))
                size += len(out[-1][-1])
                if size >= 1 << 20:
                    yield _record_batch(out, _TOLD)
                    out, size = [], 0
            if out:
                yield _record_batch(out, _TOLD)

        now, held = None, []
        for batch in batches:
            for row, rng, *sent in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (row, rng) != now and held:
                    yield from close(*now, held)
                    held = []
                now = row, rng
                held.append(sent)
        if held:
            yield from close(*now, held)

    path = stage_path(spark, "estimates")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sketch.rows * sketch.ranges // RANGES_PER_TASK)
    with small_batches(spark):
        (df.mapInArrow(send, _SENT)
         .repartition(tasks, "row", "rng").sortWithinPartitions("row", "rng", "part", "seq")
         .mapInArrow(merge, _TOLD)
         .withColumn("folder", F.floor(F.col("part") / PARTS_PER_FOLDER))
         .repartition("folder").sortWithinPartitions("folder", "part", "seq", "row", "rng")
         .write.partitionBy("folder").parquet(path))
    return sketch._replace(path=path)


class Estimates:
    """The answers for one input partition, from inside a task."""

    def __init__(self, sketch: Sketch, part: int):
        import pyarrow.dataset as ds
        from pyarrow.fs import FileType
        self.sketch, self.answers = sketch, {}
        fs, base = filesystem(sketch.path)
        folder = f"{base}/folder={part // PARTS_PER_FOLDER}"
        if fs.get_file_info(folder).type == FileType.NotFound:      # no item in these partitions
            return
        told = ds.dataset(folder, filesystem=fs, format="parquet")
        columns = ["seq", "row", "rng", "n", "answer"]
        for batch in told.to_batches(columns=columns, filter=ds.field("part") == part, batch_size=1024):
            for seq, row, *answer in zip(*(c.to_pylist() for c in batch.columns)):
                self.answers.setdefault((seq, row), []).append(answer)

    def counts(self, seq: int, h: np.ndarray) -> np.ndarray:
        """Least count, up to ``most``, that a row has for each item of chunk
        ``seq``."""
        out = np.full(len(h), self.sketch.most, dtype=np.uint8)
        for row in range(self.sketch.rows):
            u, place = np.unique(self.sketch.keys(h, row), return_inverse=True)
            told = sorted(self.answers.get((seq, row), []))
            if sum(n for _, n, _ in told) != len(u):
                raise RuntimeError("the input was not read in the same chunks twice; store it first")
            if told:
                np.minimum(out, np.concatenate([self.sketch.unpack(raw, n) for _, n, raw in told])[place], out=out)
        return out

    def repeated(self, seq: int, h: np.ndarray) -> np.ndarray:
        """True where every row counted the item of chunk ``seq`` twice or
        more."""
        return self.counts(seq, h) >= 2
