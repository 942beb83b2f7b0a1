"""Count-min sketches of hashed items, merged from partition sketches.

Every task counts its items in ``rows`` rows of ``cells`` cells and sends
sorted cell numbers as packed differences, about a byte and a half an item.
Cell blocks are merged apart, each as a stream into one small array, and
written to the shared folder: one bit a cell (``most`` 2: counted twice or
more) or one byte (counts up to 255).  Merged cells only overestimate.
Tasks read the result from the folder; it never passes through the driver,
and its size is bounded by ``cells``, whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glossa.llm import kernels
from glossa.llm.stages import read_table, small_batches, stage_path

BLOCK_CELLS = 1 << 22
FLUSH_ITEMS = 1 << 21
_ROW_SALT = (np.uint64(0), np.uint64(0x5851F42D4C957F2D))


def power_above(n: int) -> int:
    return 1 << max(10, int(n - 1).bit_length())


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted non-negative integers (below 2**32) as compressed differences."""
    import zstandard
    d = np.diff(values, prepend=values[:1] * 0).astype("<u4")
    planes = d.view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_sorted(raw: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def _cells(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (kernels.mix64(h ^ _ROW_SALT[row]) if row else h) & np.uint64(cells - 1)


def build_sketch(df: DataFrame, items, cells: int, rows: int = 2, most: int = 2) -> str:
    """Sketch of ``items(batch)`` (arrays of uint64) over the record batches
    of ``df``; returns the folder it is written to."""
    block = min(BLOCK_CELLS, cells)

    def count(batches):
        held, size = [], 0

        def flush():
            h = np.concatenate(held)
            out = []
            for row in range(rows):
                c = _cells(h, row, cells).astype(np.int64)
                c.sort()
                keep = np.ones(len(c), dtype=bool)           # at most `most` of each
                keep[most:] = c[most:] != c[:-most]
                c = c[keep]
                at = np.searchsorted(c, np.arange(0, cells + 1, block))
                out += [(row, b, pack_sorted(c[at[b]:at[b + 1]] - b * block))
                        for b in np.flatnonzero(np.diff(at)).tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))],
                names=["row", "block", "cells"])

        for batch in batches:
            for h in items(batch):
                held.append(h)
                size += len(h)
                if size >= FLUSH_ITEMS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merge(batches):
        key, counts = None, None

        def done():
            raw = np.packbits(counts >= 2, bitorder="little") if most == 2 else counts
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([raw.tobytes()], pa.binary())],
                names=["row", "block", "counts"])

        for batch in batches:
            for row, blk, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (row, blk) != key:
                    if key is not None:
                        yield done()
                    key, counts = (row, blk), np.zeros(block, dtype=np.uint8)
                u, n = np.unique(unpack_sorted(raw), return_counts=True)
                counts[u] = np.minimum(most, counts[u].astype(np.int64) + n)
        if key is not None:
            yield done()

    path = stage_path(df.sparkSession, "sketch")
    with small_batches(df.sparkSession):
        (df.mapInArrow(count, "row int, block int, cells binary")
         .repartition("row", "block").sortWithinPartitions("row", "block")
         .mapInArrow(merge, "row int, block int, counts binary").write.parquet(path))
    return path


_LOADED: dict = {}


def load_sketch(path: str, cells: int, rows: int = 2, most: int = 2) -> list[np.ndarray]:
    """The rows of a merged sketch, once per worker."""
    if path not in _LOADED:
        _LOADED.clear()
        block = min(BLOCK_CELLS, cells)
        per = 8 if most == 2 else 1
        out = [np.zeros(cells // per, dtype=np.uint8) for _ in range(rows)]
        for batch in read_table(path):
            for row, blk, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                out[row][blk * block // per:(blk + 1) * block // per] = np.frombuffer(raw, np.uint8)
        _LOADED[path] = out
    return _LOADED[path]


def estimated_repeated(h: np.ndarray, sketch: list[np.ndarray], cells: int) -> np.ndarray:
    """True where every row of a bit sketch says twice or more."""
    ok = np.ones(len(h), dtype=np.uint8)
    for row, bits in enumerate(sketch):
        c = _cells(h, row, cells)
        ok &= (bits[(c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8)) & 1
    return ok.astype(bool)


def estimated_count(h: np.ndarray, sketch: list[np.ndarray], cells: int) -> np.ndarray:
    """Least count of a byte sketch's rows."""
    return np.minimum.reduce([counts[_cells(h, row, cells).astype(np.int64)] for row, counts in enumerate(sketch)])
