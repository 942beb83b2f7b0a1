"""Model weights as files that every executor maps into memory.

A dictionary is written once, block by block of features, into the shared
folder by tasks (nothing passes through the driver) and handed to the
executors with ``SparkContext.addFile``: an executor fetches a file once and
its Python workers map it, so they share its pages and a page that is not in
use costs no memory.  A kernel walks the blocks of a model for each part of
a batch, whatever their number, in one pass over the data.

Without a SparkContext (Spark Connect) tasks read the shared folder itself.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.session import ensure_checkpoint_dir

DEFAULT_BLOCK_BYTES = 256 * 1024 * 1024     # encoder and decoder rows of one block
MAPPED_FILES = 256                          # that a worker keeps open


def filesystem(path: str):
    """(file system, path in it) of a folder as Spark names it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


@dataclass(frozen=True)
class Block:
    """Features ``lo..hi-1``: the files of their encoder and decoder rows."""

    lo: int
    hi: int
    enc: str
    dec: str


_MAPPED: dict[str, np.ndarray] = {}


def mapped(path: str, dim: int) -> np.ndarray:
    """Rows of one weight file: mapped from this executor's copy, read from
    the shared folder where there is none."""
    rows = _MAPPED.get(path)
    if rows is None:
        if len(_MAPPED) >= MAPPED_FILES:
            _MAPPED.pop(next(iter(_MAPPED)))
        fs, place = filesystem(path)
        local = place
        try:
            from pyspark import SparkFiles
            local = SparkFiles.get(path.rsplit("/", 1)[1])
        except Exception:       # no SparkContext behind this session
            pass
        local = next((f for f in (local, place) if os.path.exists(f)), None)
        if local:
            rows = np.asarray(np.memmap(local, "<f8", "r")).reshape(-1, dim)
        else:
            with fs.open_input_file(place) as f:
                rows = np.frombuffer(f.read(), "<f8").reshape(-1, dim)
        _MAPPED[path] = rows
    return rows


@dataclass
class SaeModel:
    """A dictionary ready for scoring: its sizes and its blocks."""

    input_dim: int
    dict_size: int
    sparsity: int
    blocks: list[Block] = field(default_factory=list)

    def enc(self, block: Block) -> np.ndarray:
        return mapped(block.enc, self.input_dim)

    def dec(self, block: Block) -> np.ndarray:
        return mapped(block.dec, self.input_dim)

    def widest(self) -> int:
        return max(b.hi - b.lo for b in self.blocks)

    def gather_dec(self, idx: np.ndarray) -> np.ndarray:
        """Decoder rows of an array of feature ids (only these are read)."""
        if len(self.blocks) == 1:
            return self.dec(self.blocks[0])[idx]
        out = np.empty((*idx.shape, self.input_dim))
        for b in self.blocks:
            here = (idx >= b.lo) & (idx < b.hi)
            out[here] = self.dec(b)[idx[here] - b.lo]
        return out

    def release(self) -> None:
        """Delete the weight files once the jobs that use the model are done."""
        for b in self.blocks:
            for path in (b.enc, b.dec):
                fs, place = filesystem(path)
                fs.delete_file(place)


_WRITTEN = ("block long, lo int, hi int, n long, rising boolean, d_lo int, d_hi int, enc string, dec string")


def _write_blocks(folder: str):
    """Rows sorted by block and feature -> one pair of files per block."""
    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        now = None
        for rb in batches:
            block = rb.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
            for i, j in zip(cuts, np.append(cuts[1:], len(block))):
                if now is None or now["block"] != block[i]:
                    if now is not None:
                        yield _close(now)
                    name = f"{folder}/{uuid.uuid4().hex}-{int(block[i]):06d}"
                    now = {"block": int(block[i]), "files": [name + ".enc", name + ".dec"], "n": 0, "rising": True,
                           "lo": None, "hi": -1, "d_lo": None, "d_hi": None}
                    now["out"] = [fs.open_output_stream(filesystem(f)[1]) for f in now["files"]]
                part = rb.slice(i, j - i)
                ids = part.column(1).to_numpy(zero_copy_only=False)
                now["rising"] &= bool((np.diff(np.append(now["hi"], ids)) > 0).all())
                now["lo"] = int(ids[0]) if now["lo"] is None else now["lo"]
                now["hi"], now["n"] = int(ids[-1]), now["n"] + len(ids)
                for k, out in enumerate(now["out"]):
                    col = part.column(2 + k)
                    lens = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
                    least, most = int(lens.min()), int(lens.max())
                    now["d_lo"] = least if now["d_lo"] is None else min(now["d_lo"], least)
                    now["d_hi"] = most if now["d_hi"] is None else max(now["d_hi"], most)
                    out.write(col.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes())
        if now is not None:
            yield _close(now)
    return run


def _close(now: dict) -> pa.RecordBatch:
    for out in now["out"]:
        out.close()
    return pa.RecordBatch.from_pydict({
        "block": pa.array([now["block"]], pa.int64()), "lo": pa.array([now["lo"]], pa.int32()),
        "hi": pa.array([now["hi"]], pa.int32()), "n": pa.array([now["n"]], pa.int64()),
        "rising": [now["rising"]], "d_lo": pa.array([now["d_lo"]], pa.int32()),
        "d_hi": pa.array([now["d_hi"]], pa.int32()), "enc": [now["files"][0]], "dec": [now["files"][1]]})


def load_model(atoms: DataFrame, sparsity: int, max_block_bytes: int = DEFAULT_BLOCK_BYTES) -> SaeModel:
    """Write the table ``(feature, enc, dec)`` as weight files and check it:
    features are the dense ids ``0..dict_size-1`` and every vector has the
    same length.  One job; the driver sees one row per block."""
    spark = atoms.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models"
    enc, dec = F.col("enc").cast("array<double>"), F.col("dec").cast("array<double>")
    per_block = F.greatest(F.lit(1), F.floor(F.lit(max_block_bytes) / (F.size("enc") * 16)))
    rows = atoms.select(F.coalesce(F.floor(F.col("feature") / per_block), F.lit(-1)).cast("long").alias("block"),
                        F.coalesce(F.col("feature"), F.lit(-1)).cast("int").alias("feature"),
                        enc.alias("enc"), dec.alias("dec"))
    written = (rows.repartition("block").sortWithinPartitions("block", "feature")
               .mapInArrow(_write_blocks(folder), _WRITTEN).collect())
    written.sort(key=lambda r: r["block"])
    model = SaeModel(0, 0, int(sparsity), [Block(r["lo"], r["hi"] + 1, r["enc"], r["dec"]) for r in written])
    problem = None
    if not written:
        problem = "empty dictionary"
    elif any(r["d_lo"] != r["d_hi"] or r["d_lo"] != written[0]["d_lo"] or r["d_lo"] < 1 for r in written):
        problem = "every enc and dec vector must have the input dimension"
    else:
        at = 0
        for r in written:
            if r["lo"] != at or not r["rising"] or r["n"] != r["hi"] + 1 - r["lo"]:
                problem = "atom features must be the dense ids 0..dict_size-1"
            at = r["hi"] + 1
    if problem:
        model.release()
        raise ValueError(problem)
    model.input_dim, model.dict_size = written[0]["d_lo"], written[-1]["hi"] + 1
    try:
        context = spark.sparkContext
    except Exception:           # Spark Connect: tasks read the shared folder
        return model
    for b in model.blocks:
        context.addFile(b.enc)
        context.addFile(b.dec)
    return model
