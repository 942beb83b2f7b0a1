"""Access to the Parquet tables of one scale factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One table as a lazily scanned Parquet DataFrame (filters and
    projections reach the scan).  ``spread``: see ``spread``."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_if_narrow(df) if spread else df


def spread_if_narrow(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work (tokenising, chunking) all cores when the
    scan yields fewer splits than the cluster has cores (a file with one row
    group is read by one task).  A scan of many files already has enough
    splits and is left alone, so at scale this adds no shuffle."""
    from glossa.session import cores, num_partitions
    want = cores(df.sparkSession)
    n = num_partitions(df)
    if n is not None and n < want:
        return df.repartition(want)
    return df
