"""Operator 2: token ids in compressed binary files with random access.

File format (one file per range of document ids, little-endian):

    "GLTOK001" | id width u8 (2 or 4) | sha256 of the dictionary (32 bytes)
    one zstandard frame per document: its id array, compressed by itself
        with the shared dictionary
    document ids i64[n] | id present u8[n] | frame offsets u64[n + 1]
        | token counts u64[n]
    n u64 | offset of this index u64 | "GLTOKEND"

The shared dictionary is trained on the id arrays of a bounded sample: the
``SAMPLE_DOCS`` documents of smallest ``xxhash64(id)``, ``SAMPLE_CHARS``
characters of each, from a place given by the hash.  Every file names the dictionary by its
hash; the dictionary itself lies beside the files.  A short document is read
by seeking to its frame: nothing before it is decompressed.

Writing is one range shuffle by document id and one pass that streams each
partition into its file; a task holds one Arrow batch, the frame being
written and the index of its file.  There are at least as many files as
``FILE_BYTES`` of text, so files and their indexes do not grow.  File names are unique per attempt and
the manifest (one row per file) names only files of tasks that finished, so
a lost executor or a repeated task never leaves a file half used.

Defined cases: null text counts as empty (only the end id); null document
ids sort first and come back null; equal ids are kept, ordered by a hash of
their text; an empty table gives no file and no row; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm.stages import stage_path
from glossa.llm.tokens import encoder, tokenizer_path

HEAD, TAIL = b"GLTOK001", b"GLTOKEND"
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 8192
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
ENCODE_ROWS = 256
FILE_BYTES = 256 << 20      # of texts

MANIFEST = ("shard long, path string, n_docs long, n_tokens long, "
            "first_id long, last_id long, n_bytes long")
INDEX = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _filesystem(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else "file:" + path.removeprefix("file:"))


def train_dictionary(samples: list[bytes]) -> bytes:
    """Dictionary bytes from serialized id arrays; with too few samples for
    training, the samples themselves (raw content), empty without any."""
    import zstandard
    samples = [s for s in samples if len(s) >= 8]
    total = sum(map(len, samples))
    try:
        if total > 4 * DICTIONARY_BYTES and len(samples) >= 50:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"".join(samples)[:DICTIONARY_BYTES]


def sample_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int,
                      id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """Train on the bounded sample named in the module text."""
    text, h = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.xxhash64(F.col(id_col))
    spare = F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0))
    picked = (docs.select(F.substr(text, (F.pmod(h, spare + 1) + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("t"), h.alias("h"))
              .orderBy("h", "t").limit(SAMPLE_DOCS).toArrow().column("t").to_pylist())
    enc = encoder(tokenizer, "space")
    return train_dictionary([_narrow(i + _end(end_id), width) for i in enc.encode(picked)])


def id_width(tokenizer: str, end_id: int, width: int | None = None) -> int:
    """Bytes of an id in the files: 2 where the vocabulary and the end id
    allow it, else 4; a ``width`` that is too small is an error."""
    largest = max(encoder(tokenizer, "space").largest_id(), end_id)
    if width not in (None, 2, 4) or width == 2 and largest >= 1 << 16:
        raise ValueError(f"ids up to {largest} do not fit {width} bytes")
    return width or (2 if largest < 1 << 16 else 4)


def _end(end_id: int) -> bytes:
    return struct.pack("<I", end_id)


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _wide(raw: bytes, width: int) -> bytes:
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def _zdict(data: bytes):
    import zstandard
    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0,
                      width: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` into files under ``folder``; returns the manifest (one
    row per file with its documents, tokens and place), read back from the
    folder."""
    spark = docs.sparkSession
    width = id_width(tokenizer, end_id, width)
    dictionary = sample_dictionary(docs, tokenizer, end_id, width, id_col, text_col)
    digest = hashlib.sha256(dictionary).digest()
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{digest.hex()}.dict") as f:
        f.write(dictionary)

    def write(batches):
        import zstandard
        from pyspark import TaskContext
        enc = encoder(tokenizer, "space")
        zd = _zdict(dictionary)
        zc = zstandard.ZstdCompressor(level=LEVEL, dict_data=zd) if zd else zstandard.ZstdCompressor(level=LEVEL)
        out, ids, has, offsets, counts = None, [], [], [], []
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                part = batch.slice(at, ENCODE_ROWS)
                if out is None:
                    task_fs, task_base = _filesystem(folder)
                    name = f"{task_base}/tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.gltok"
                    out = task_fs.open_output_stream(name)
                    out.write(HEAD + bytes([width]) + digest)
                    place = len(HEAD) + 1 + len(digest)
                keys = part.column(0).to_pylist()
                for key, raw in zip(keys, enc.encode(part.column(1).to_pylist())):
                    raw += _end(end_id)
                    frame = zc.compress(_narrow(raw, width))
                    out.write(frame)
                    ids.append(key or 0)
                    has.append(key is not None)
                    offsets.append(place)
                    counts.append(len(raw) // 4)
                    place += len(frame)
        enc.rest()
        if out is None:
            return
        index = (np.asarray(ids, "<i8").tobytes() + np.asarray(has, "u1").tobytes()
                 + np.asarray(offsets + [place], "<u8").tobytes() + np.asarray(counts, "<u8").tobytes())
        out.write(index)
        out.write(struct.pack("<QQ", len(ids), place) + TAIL)
        out.close()
        known = [i for i, h in zip(ids, has) if h]
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([TaskContext.get().partitionId()], pa.int64()),
            "path": pa.array([name]), "n_docs": pa.array([len(ids)], pa.int64()),
            "n_tokens": pa.array([sum(counts)], pa.int64()),
            "first_id": pa.array([min(known, default=None)], pa.int64()),
            "last_id": pa.array([max(known, default=None)], pa.int64()),
            "n_bytes": pa.array([place + len(index) + 24], pa.int64())})

    keyed = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    size = keyed.agg(F.sum(F.octet_length(F.col("_text").cast("string")))).first()[0] or 0
    files = size // FILE_BYTES
    few = files <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (keyed.repartitionByRange(*([] if few else [files]), "_id", F.xxhash64("_text"))
               .sortWithinPartitions("_id", F.xxhash64("_text")))
    path = f"{folder}/manifest"
    ordered.mapInArrow(write, MANIFEST).write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


class TokenFile:
    """Random access to one token file."""

    def __init__(self, path: str, folder: str):
        import zstandard
        self.fs, base = _filesystem(folder)
        self.f = self.fs.open_input_file(path)
        size = self.f.size()
        head = self.f.read_at(len(HEAD) + 33, 0)
        n, at = struct.unpack("<QQ", self.f.read_at(24, size - 24)[:16])
        if head[:8] != HEAD or self.f.read_at(8, size - 8) != TAIL:
            raise ValueError(f"not a token file: {path}")
        self.width, digest = head[8], head[9:]
        with self.fs.open_input_stream(f"{base}/{digest.hex()}.dict") as d:
            dictionary = d.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"dictionary of {path} has another hash")
        zd = _zdict(dictionary)
        self.z = zstandard.ZstdDecompressor(dict_data=zd) if zd else zstandard.ZstdDecompressor()
        index = self.f.read_at(n * 25 + 8, at)
        self.ids = np.frombuffer(index, "<i8", n)
        self.has = np.frombuffer(index, "u1", n, n * 8)
        self.offsets = np.frombuffer(index, "<u8", n + 1, n * 9)
        self.counts = np.frombuffer(index, "<u8", n, n * 17 + 8)

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, i: int) -> np.ndarray:
        """Token ids of the ``i``-th document of the file, by its offset."""
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return np.frombuffer(_wide(self.z.decompress(self.f.read_at(b - a, a)), self.width), "<u4")

    def close(self) -> None:
        self.f.close()


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: id, first token's place in the
    whole corpus, number of tokens and their checksum."""
    n = manifest.count()
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("at"))
    rows = (placed.withColumn("slot", F.row_number().over(Window.orderBy("shard")) - 1)
            .repartitionById(max(n, 1), F.col("slot").cast("int")).select("path", "at"))

    def read(batches):
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = TokenFile(path, folder)
                starts = at + np.concatenate([[0], np.cumsum(f.counts)[:-1]]) if len(f) else np.zeros(0)
                for lo in range(0, len(f), 4096):
                    hi = min(len(f), lo + 4096)
                    got = [f.document(i) for i in range(lo, hi)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(f.ids[lo:hi], pa.int64(), mask=f.has[lo:hi] == 0),
                        "start": pa.array(starts[lo:hi].astype(np.int64)),
                        "n_tokens": pa.array([len(g) for g in got], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(g.tobytes()) for g in got], pa.int64())})
                f.close()

    return rows.mapInArrow(read, INDEX)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of ``documents`` (byte-level vocabulary, end id 0), read
    back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = stage_path(spark, "tokens")
    manifest = write_token_files(docs, folder, tokenizer_path("byte_bpe_50k.json"))
    return read_token_files(manifest, folder)
