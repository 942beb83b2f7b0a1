"""Writers (K1-K5).  Spark's file commit protocol makes every write
atomic per job; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.retrieval import pending


def write_jsonl(df: DataFrame, path: str, order_within: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """K1: one JSON object per line, UTF-8 unescaped; with ``order_within``
    each output file keeps that order (e.g. set id, language order)."""
    out = df.sortWithinPartitions(*order_within) if order_within else df
    out.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_statistics(df: DataFrame, path: str) -> None:
    """K2: a statistics table as JSON documents (one line per row, nested
    columns kept as JSON objects)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_embeddings(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """K3: vectors keyed by id as Parquet."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def existing_results(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """Keys that already have a result at ``path`` (None: nothing written),
    to be passed to the scoring job, which skips them before it scores."""
    try:
        return spark.read.parquet(path).select(*keys).distinct()
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e) \
                and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def write_results(spark: SparkSession, results: DataFrame, path: str,
                  keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """K4: append results partitioned by ``keys``; rows whose key already has
    a result are skipped unless ``overwrite`` (then only the touched
    partitions are replaced: dynamic overwrite as an option of this write,
    the session is left alone).  Returns what was written."""
    keys = list(keys)
    if overwrite:
        results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
        return results
    existing = existing_results(spark, path, keys)
    todo = results if existing is None else pending(results, existing, keys)
    todo.write.mode("append").partitionBy(*keys).parquet(path)
    return todo


def write_model(spark: SparkSession, atoms: DataFrame, meta: dict, path: str) -> None:
    """K5: the dictionary as ``atoms`` Parquet plus a one-row ``meta`` table
    (input_dim, dict_size, expansion_factor, sparsity always stored)."""
    required = {"input_dim", "dict_size", "expansion_factor", "sparsity"}
    missing = required - set(meta)
    if missing:
        raise ValueError(f"model metadata lacks {sorted(missing)}")
    atoms.select(F.col("feature").cast("int"), F.col("enc").cast("array<double>"),
                 F.col("dec").cast("array<double>")).write.mode("overwrite").parquet(f"{path}/atoms")
    spark.createDataFrame([meta]).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """K5: ``(atoms, meta)``; dimensions are checked against the atoms."""
    atoms = spark.read.parquet(f"{path}/atoms")
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    stats = atoms.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("enc")).alias("d")).first()
    if stats["n"] != meta["dict_size"] or stats["d"] != meta["input_dim"]:
        raise ValueError("model metadata does not match its atoms")
    return atoms, meta
