"""Shared-folder stage tables: cut lineage, survive lost executors.

Stage tables and files lie under the folder that the session names in
``spark.checkpoint.dir`` (a local folder is made only where it is unset, as
in tests).  Every run takes a fresh sub-folder, so reruns never mix.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from glossa.session import ensure_checkpoint_dir


_NOTED: list[list[str]] = []


@contextmanager
def noted_paths():
    """The stage paths made inside, as a list: whoever has stored a result
    that was read from them can remove them."""
    made: list[str] = []
    _NOTED.append(made)
    try:
        yield made
    finally:
        _NOTED.remove(made)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    for made in _NOTED:
        made.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """As ``staged``, with the path, for tables that are removed later."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete stage tables that nothing will read again."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Jobs started inside hand texts to Python ``rows`` at a time (the
    session's own setting is restored): less memory on both sides where rows
    are whole documents."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(path: str):
    """(file system, path in it) of a folder as Spark names it."""
    from pyarrow import fs
    if "://" not in path:
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def read_table(path: str):
    """Record batches of a stage table, from inside a task (for tables of a
    proven size bound only)."""
    import pyarrow.dataset as ds
    fs, base = filesystem(path)
    yield from ds.dataset(base, filesystem=fs, format="parquet").to_batches(batch_size=64)
