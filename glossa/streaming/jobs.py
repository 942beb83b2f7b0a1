"""Structured Streaming forms of the SAE jobs.

Each job reads new Parquet files of a folder, applies the same operator as
the batch job and writes with a checkpoint, so a restarted query resumes
where it stopped and every input file is processed once.  The dictionary's
weight files are handed to the executors when the query is defined.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from glossa.operators import encoder, sae


def _source(spark: SparkSession, input_dir: str, schema: T.StructType,
            max_files: int | None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(input_dir)


def stream_agnostic(spark: SparkSession, input_dir: str, schema: T.StructType,
                    model: sae.SaeModel, mask_features, out_dir: str, checkpoint: str,
                    vec_col: str = "embedding", decode: bool = False,
                    available_now: bool = True, max_files: int | None = None) -> StreamingQuery:
    """New vectors in, language-agnostic features (D4) or their
    reconstruction (D5) out; stateless, append mode."""
    src = _source(spark, input_dir, schema, max_files)
    out = sae.encode_topk(src, model, vec_col=vec_col, mask_features=mask_features, ranks=True)
    if decode:
        out = sae.decode(out, model)
    w = out.writeStream.format("parquet").option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(out_dir)


def stream_firing_counts(spark: SparkSession, input_dir: str, schema: T.StructType,
                         model: sae.SaeModel, out_dir: str, checkpoint: str,
                         language_col: str = "language", vec_col: str = "embedding",
                         available_now: bool = True, max_files: int | None = None,
                         keep_versions: int = 2) -> StreamingQuery:
    """R2: firing counts kept up to date.  Counts are additive: a micro-batch
    is counted by the batch operator, added to the newest version of the
    table and written as the next one.  A version counts only from its entry
    in the log (``VersionLog``), which is made after its files are complete
    and names the stream and the micro-batch, so a micro-batch that is run
    again adds nothing.  Versions older than the ``keep_versions`` newest go.
    A stream with a new checkpoint starts from zero."""
    src = _source(spark, input_dir, schema, max_files)
    log = VersionLog(spark, out_dir)

    def sink(batch: DataFrame, epoch_id: int) -> None:
        last = log.newest()
        mine = last is not None and last["stream"] == checkpoint
        if mine and last["epoch"] >= epoch_id:
            return
        counts = sae.firing_counts(batch, model, language_col=language_col, vec_col=vec_col)
        if mine:
            counts = counts.unionByName(batch.sparkSession.read.parquet(last["path"])).groupBy("language", "feature") \
                .agg(F.sum("n").alias("n"))
        path = f"{out_dir}/data/{uuid.uuid4().hex}"
        counts.write.parquet(path)
        log.commit(path, checkpoint, epoch_id)
        log.retain(keep_versions)

    w = src.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


class VersionLog:
    """Committed versions of a table: one small file per version under
    ``_versions``, written whole and then renamed to its number."""

    def __init__(self, spark: SparkSession, out_dir: str):
        self.spark, self.folder = spark, f"{out_dir.rstrip('/')}/_versions"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, folder = self._fs(self.folder)
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def entry(self, version: int) -> dict:
        fs, p = self._fs(f"{self.folder}/{version:012d}.json")
        f = fs.open(p)
        try:
            return json.loads(bytes(f.readAllBytes()).decode("utf-8"))
        finally:
            f.close()

    def newest(self) -> dict | None:
        there = self.versions()
        return self.entry(there[-1]) if there else None

    def commit(self, path: str, stream: str, epoch: int) -> int:
        version = (self.versions() or [0])[-1] + 1
        body = json.dumps({"version": version, "path": path, "stream": stream, "epoch": epoch})
        fs, draft = self._fs(f"{self.folder}/.{version:012d}-{uuid.uuid4().hex}")
        f = fs.create(draft, True)
        f.write(bytearray(body.encode("utf-8")))
        f.close()
        _, place = self._fs(f"{self.folder}/{version:012d}.json")
        if not fs.rename(draft, place):
            raise IOError(f"version {version} of {self.folder} was committed by another stream")
        return version

    def retain(self, n: int) -> None:
        """Forget and delete all but the ``n`` newest versions."""
        for version in self.versions()[:-max(1, n)]:
            entry = self.entry(version)
            for path in (f"{self.folder}/{version:012d}.json", entry["path"]):
                fs, p = self._fs(path)
                fs.delete(p, True)


def latest_firing_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """The counts of the newest committed version."""
    entry = VersionLog(spark, out_dir).newest()
    if entry is None:
        raise ValueError(f"no version of the counts was committed in {out_dir}")
    return spark.read.parquet(entry["path"])


def stream_embed(spark: SparkSession, input_dir: str, schema: T.StructType,
                 factory: Callable, out_dir: str, checkpoint: str, text_col: str = "text",
                 available_now: bool = True, max_files: int | None = None) -> StreamingQuery:
    """Texts in, vectors out; the checkpoint records which files were
    embedded, so only unseen input is encoded.  Progress (rows per
    trigger) is in ``StreamingQuery.lastProgress``."""
    src = _source(spark, input_dir, schema, max_files)
    out = encoder.encode_texts(src, factory, text_col)
    w = out.writeStream.format("parquet").option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(out_dir)
