"""Numpy kernels on packed texts: words, rolling hashes, windows.

A *pack* is a run of texts laid end to end in one byte array with offsets
(exactly an Arrow string column's buffers), cut so that it holds at most
``PACK_BYTES`` bytes or one text.  All kernels work on a whole pack at once,
so the cost per byte is a few nanoseconds and the memory is bounded by the
pack, not by the partition.

A word is a maximal run of bytes outside space and 0x09-0x0D; since those
bytes never occur inside a UTF-8 sequence, bytes and characters agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PACK_BYTES = 1 << 18

_M64 = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element (wrapping uint64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base & _M64, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << max(12, (n - 1).bit_length())
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(m, np.uint64(b), dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = _Powers(_BYTE_BASE)
_WORD_POWERS = tuple(_Powers(b) for b in _WORD_BASES)


@dataclass
class Pack:
    """Texts of rows ``first .. first + n`` of a batch, end to end."""

    first: int
    data: np.ndarray      # uint8
    offsets: np.ndarray   # int64, n + 1 entries from 0

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def packs(column, limit: int = PACK_BYTES):
    """Cut a string/binary Arrow column into packs; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    _, obuf, dbuf = column.buffers()
    offs = np.frombuffer(obuf, dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(dbuf, dtype=np.uint8) if dbuf is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield Pack(at, raw[offs[at]:offs[end]], offs[at:end + 1] - offs[at])
        at = end


def fixed_rows(batches, rows: int):
    """Record batches of exactly ``rows`` rows (the last may have fewer),
    however the input is cut: what is made of them depends on the rows alone."""
    held, n = [], 0

    def joined():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        at = 0
        while at < b.num_rows:
            take = min(rows - n, b.num_rows - at)
            held.append(b.slice(at, take))
            n, at = n + take, at + take
            if n == rows:
                yield joined()
                held, n = [], 0
    if n:
        yield joined()


@dataclass
class Words:
    """Words of a pack in order: byte spans and the text each belongs to."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray     # first word of each text, n + 1 entries

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(pack: Pack) -> Words:
    solid = ~_SPACE[pack.data]
    n = len(solid)
    begin = np.zeros(n + 1, dtype=bool)     # a text begins (or all ends) here
    begin[pack.offsets] = True
    left = np.empty(n, dtype=bool)
    right = np.empty(n, dtype=bool)
    if n:
        left[0] = True
        np.logical_not(solid[:-1], out=left[1:])
        left |= begin[:-1]
        left &= solid
        right[-1] = True
        np.logical_not(solid[1:], out=right[:-1])
        right |= begin[1:]
        right &= solid
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    return Words(start, end, np.searchsorted(start, pack.offsets))


def _prefix(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up, dtype=np.uint64, out=out[1:])
    return out


def byte_prefix(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums of byte values times powers: the hash of any span follows
    from two entries (``span_hash``)."""
    up, _ = _BYTE_POWERS.upto(len(data))
    return _prefix((_BYTE_VALUES[_LOWER[data]] if lower else _BYTE_VALUES[data]), up)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _BYTE_POWERS.upto(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(pack: Pack, w: Words, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word (A-Z folded when ``lower``)."""
    if not len(w.start):
        return np.zeros(0, dtype=np.uint64)
    return span_hash(byte_prefix(pack.data, lower), w.start, w.end)


def window_hashes(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (across texts too:
    the caller masks windows that leave their text)."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WORD_POWERS[lane].upto(n + 1)
    p = _prefix(mix64(h ^ np.uint64(_WORD_BASES[lane])), up[:n])
    return mix64((p[k:] - p[:-k]) * down[:n - k + 1] + np.uint64(k))


def run_hash(h: np.ndarray, lane: int = 0) -> int:
    """Hash of a whole sequence of word hashes."""
    w = window_hashes(h, len(h), lane) if len(h) else np.zeros(1, np.uint64)
    return int(w[0])


def window_mask(w: Words, k: int, total: int) -> np.ndarray:
    """True where a window of ``k`` words stays inside its text."""
    n = max(0, total - k + 1)
    ok = np.ones(n, dtype=bool)
    ends = w.first[1:]
    starts = w.first[:-1]
    # windows starting in the last k - 1 words of a text leave it
    bad_from = np.maximum(starts, ends - (k - 1))
    for a, b in zip(bad_from, np.minimum(ends, n)):
        if a < b:
            ok[a:b] = False
    return ok
