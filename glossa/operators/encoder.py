"""Encoder and tokenizer hooks (U1, U2) and incremental embedding.

An encoder is given as a picklable *factory*: a zero-argument callable that
returns ``encode(list[str]) -> np.ndarray (n, dim)``.  Each Python worker
builds it once and reuses it for every Arrow batch of every task, so a
heavy model is loaded once per worker, not per row or per batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORKER_CACHE: dict = {}
PIECE_CHARS = 1 << 22         # characters that are cut into white-space tokens at once


def _pieces(texts):
    """Ranges of texts that hold about ``PIECE_CHARS`` characters together."""
    i = size = 0
    for j, t in enumerate(texts, 1):
        size += len(t or "")
        if size >= PIECE_CHARS or j == len(texts):
            yield i, j
            i, size = j, 0


class HashedBagOfWords:
    """Default test encoder: whitespace tokens (the Catalyst tokenizer's
    ASCII whitespace class) hashed into ``dim`` buckets by the first 8 hex
    digits of their md5, counts L2-normalised.  Deterministic across
    processes and expressible in SQL, so its output can be checked."""

    def __init__(self, dim: int = 64):
        self.dim = int(dim)

    def __call__(self):
        from hashlib import md5
        dim = self.dim

        def counts(texts):
            raw = [t.encode("utf-8") for t in texts]
            lengths = np.array([len(t) for t in raw], dtype=np.int64)
            begin = np.cumsum(lengths + 1) - lengths                # of each text among all bytes
            data = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
            white = (data == 32) | ((data >= 9) & (data <= 13))     # as the Catalyst tokenizer has it
            edge = np.flatnonzero(white[1:] != white[:-1]) + 1
            ends = np.append(0, np.cumsum(edge[1::2] - edge[::2])).astype(np.int32)
            words = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1,
                                                [None, pa.py_buffer(ends), pa.py_buffer(data[~white])]).dictionary_encode()
            of = np.frombuffer(b"".join([md5(w).digest()[:4] for w in words.dictionary.to_pylist()]), ">u4") % dim
            text = np.repeat(np.arange(len(raw)), np.diff(np.searchsorted(edge[::2], np.append(begin, len(data)))))
            return np.bincount(text * dim + of[words.indices.to_numpy()], minlength=len(raw) * dim).reshape(len(raw), dim)

        def encode(texts):
            out = np.zeros((len(texts), dim))
            for i, j in _pieces(texts):
                out[i:j] = counts([(t or "").strip() for t in texts[i:j]])
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return out / np.maximum(norm, 1e-12)
        return encode


def _get(factory):
    state = getattr(factory, "__dict__", None)
    key = (type(factory).__qualname__,
           tuple(sorted((k, repr(v)) for k, v in state.items())) if state else id(factory))
    fn = _WORKER_CACHE.get(key)
    if fn is None:
        fn = factory()
        _WORKER_CACHE[key] = fn
    return fn


def encode_texts(df: DataFrame, factory: Callable, text_col: str = "text",
                 out_col: str = "embedding", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``out_col ARRAY<FLOAT>`` computed by the encoder in Arrow
    batches (``spark.sql.execution.arrow.maxRecordsPerBatch`` rows each)."""
    keep_cols = list(keep) if keep is not None else [c for c in df.columns if c != out_col]
    fields = [df.schema[c] for c in keep_cols] + [
        T.StructField(out_col, T.ArrayType(T.FloatType()))]
    schema = T.StructType(fields)
    src = df.select(*keep_cols, *([] if text_col in keep_cols else [text_col]))

    def run(batches):
        enc = _get(factory)
        for rb in batches:
            texts = rb.column(text_col).to_pylist()
            mat = np.asarray(enc([t or "" for t in texts]), dtype=np.float32)
            n, dim = mat.shape
            offsets = np.arange(0, (n + 1) * dim, dim, dtype=np.int32)
            vec = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                           pa.array(mat.reshape(-1), pa.float32()))
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in keep_cols] + [vec],
                                             names=[f.name for f in fields])

    return src.mapInArrow(run, schema)


class WhiteSpaceSpans:
    """Default span tokenizer: runs of non-white-space characters (the ASCII
    white space of the Catalyst tokenizer)."""

    special_tokens = 2

    def __call__(self):
        def piece(texts):
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            begin = np.cumsum(lengths + 1) - lengths - 1            # of each text among all characters
            chars = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
            white = (chars == 32) | ((chars >= 9) & (chars <= 13))
            edge = np.flatnonzero(white[1:] != white[:-1])
            first, after = edge[::2], edge[1::2]
            at = np.searchsorted(first, np.append(begin, len(chars)))
            shift = np.repeat(begin, np.diff(at))
            pairs = np.stack([first - shift, after - shift], axis=1)
            return [pairs[i:j] for i, j in zip(at[:-1], at[1:])]

        def spans(texts):
            return [x for i, j in _pieces(texts) for x in piece(texts[i:j])]
        return spans


class FileSpans:
    """Spans by a tokenizer file of the ``tokenizers`` library (any subword
    vocabulary); ``special_tokens``: how many the model adds to a text."""

    def __init__(self, path: str, special_tokens: int = 2):
        self.path, self.special_tokens = path, special_tokens

    def __call__(self):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(self.path)
        tok.no_truncation()
        tok.no_padding()

        def spans(texts):
            return [np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
                    for e in tok.encode_batch(texts, add_special_tokens=False)]
        return spans


def _slices(text: str, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans of a text, end to end, and their lengths."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    first, after = spans[:, 0], spans[:, 1]
    if len(data) != len(text):                      # places of characters among the bytes
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first, after = place[first], place[after]
    size = after - first
    shift = first - (np.cumsum(size) - size)
    return data[np.arange(int(size.sum())) + np.repeat(shift, size)], size


def token_spans(df: DataFrame, tokenizer: Callable | None = None, text_col: str = "text",
                out_col: str = "spans", words_col: str | None = None) -> DataFrame:
    """The tokens of a text as character spans of it,
    ``ARRAY<STRUCT<first INT, after INT>>``, so that a token, or any run of
    tokens, can be taken back as text (``span_text``).  ``tokenizer`` is a
    picklable factory of ``spans(list[str])``; default: white space.
    ``words_col`` adds all tokens taken back as text, ``ARRAY<STRING>``, in
    one walk of the text (one ``substring`` a token walks it each time)."""
    tokenizer = tokenizer or WhiteSpaceSpans()
    keep = [f for f in df.schema.fields if f.name not in (out_col, words_col)]
    pair = pa.struct([("first", pa.int32()), ("after", pa.int32())])
    schema = T.StructType([*keep, T.StructField(out_col, T.ArrayType(T.StructType([
        T.StructField("first", T.IntegerType()), T.StructField("after", T.IntegerType())]))),
        *([T.StructField(words_col, T.ArrayType(T.StringType()))] if words_col else [])])

    def run(batches):
        cut = _get(tokenizer)
        for whole in batches:
            at = 0
            while at < whole.num_rows:              # parts of bounded text
                rb = whole.slice(at, _rows_of(whole.column(text_col), at))
                at += rb.num_rows
                texts = [t or "" for t in rb.column(text_col).to_pylist()]
                found = cut(texts)
                offsets = pa.array(np.cumsum([0] + [len(f) for f in found]).astype(np.int32))
                flat = np.concatenate(found).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(pair))
                out = [*(rb.column(f.name) for f in keep), pa.ListArray.from_arrays(offsets, pairs)]
                if words_col:
                    parts = [_slices(t, f) for t, f in zip(texts, found)]
                    ends = np.append(0, np.cumsum(np.concatenate([n for _, n in parts]))).astype(np.int32)
                    words = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends),
                                                        pa.py_buffer(np.concatenate([raw for raw, _ in parts])))
                    out.append(pa.ListArray.from_arrays(offsets, words))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return df.mapInArrow(run, schema)


def _rows_of(texts: pa.Array, at: int, most: int = 8 << 20) -> int:
    """Rows from ``at`` on that hold about ``most`` bytes of text, one at least."""
    size = pc.fill_null(pc.binary_length(texts.slice(at)), 0).to_numpy(zero_copy_only=False)
    return max(1, int(np.searchsorted(np.cumsum(size, dtype=np.int64), most, side="right")))


def span_text(text, spans, first, count):
    """The text of ``count`` tokens from token ``first`` (0-based) on, as it
    stands in the text; '' where there are none."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    some = F.slice(c(spans), F.lit(first) + 1, F.lit(count))
    begin, end = F.element_at(some, 1)["first"], F.element_at(some, -1)["after"]
    return F.when(F.size(some) > 0, F.substring(c(text), begin + 1, end - begin)).otherwise(F.lit(""))


def embed_pending(texts: DataFrame, done: DataFrame, factory: Callable, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Embed only the rows whose id has no vector yet (row
    granularity, ``left_anti`` before the expensive step); the caller
    appends the result to the vector table."""
    todo = texts.join(done.select(id_col).distinct(), id_col, "left_anti")
    return encode_texts(todo, factory, text_col)
