"""Session helpers: local sessions for tests and benches, checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL_FOLDER: dict[str, str] = {}      # of a local session that names none


def _driver_memory() -> str:
    """Local mode: half of the machine's memory, at most 8 GB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    mb = max(1024, min(8192, int(total * 0.5 / (1024 * 1024))))
    return f"{mb}m"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "glossa") -> SparkSession:
    """A local session configured the way the cluster job expects.

    AQE coalesces and splits shuffle partitions at run time; skew-join
    handling splits hot join keys.  The UI is off: no server is opened.
    A checkpoint folder is made only because none is named (tests).
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GLOSSA_DRIVER_MEMORY", _driver_memory()))
    )
    if not os.environ.get("GLOSSA_CHECKPOINT_DIR"):
        builder = builder.config(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="glossa-ckpt-"))
    else:
        builder = builder.config(CHECKPOINT_CONF, os.environ["GLOSSA_CHECKPOINT_DIR"])
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # pragma: no cover - no SparkContext (Connect)
        pass
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``."""
    try:
        path = spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    except Exception:  # pragma: no cover - no SparkContext (Connect)
        path = None
    if not path:
        try:
            path = spark.conf.get(CHECKPOINT_CONF, None)
        except Exception:  # pragma: no cover - conf access differs by mode
            path = None
    return path or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point ``DataFrame.checkpoint()`` at the session's shared folder.

    The setting is read from the session.  Only a local session without it
    (as in tests) gets a local folder; on a cluster, whose executors would
    not share that folder, a missing setting is an error.
    """
    path = checkpoint_dir(spark)
    if not path:
        path = _LOCAL_FOLDER.get("path")
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share (master {master})")
        path = _LOCAL_FOLDER["path"] = tempfile.mkdtemp(prefix="glossa-ckpt-")
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:  # pragma: no cover - no SparkContext (Connect)
        pass
    return path


_STAGED: list[tuple[str, str]] = []      # (application, path) of stage tables not yet removed


def materialize(df, name: str = "stage", partition_by=()):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: later actions start from the files (lineage cut, one columnar
    write, survives executor loss).  Used where a table feeds several
    actions; ``drop_stages`` removes the tables when the results are out."""
    import uuid
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    w = df.write.partitionBy(*partition_by) if partition_by else df.write
    w.parquet(path)
    _STAGED.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


def remove_table(df) -> None:
    """Remove a table that ``materialize`` wrote, once nothing reads it."""
    spark = df.sparkSession
    roots = {p for _, p in _STAGED if any(f.startswith((p, f"file:{p}", f"file://{p}")) for f in df.inputFiles())}
    for p in roots:
        _delete(spark, p)
    _STAGED[:] = [x for x in _STAGED if x[1] not in roots]


def _delete(spark, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stages(spark: SparkSession) -> int:
    """Remove this application's stage tables; returns how many."""
    app = spark.sparkContext.applicationId
    mine = [p for a, p in _STAGED if a == app]
    for p in mine:
        _delete(spark, p)
    _STAGED[:] = [x for x in _STAGED if x[0] != app]
    return len(mine)


class _Shipped:
    """Stand-in for a broadcast where the session has no SparkContext
    (Spark Connect): the value travels with the task closure."""

    def __init__(self, value):
        self.value = value

    def unpersist(self, blocking: bool = False) -> None:
        pass


def broadcast(spark: SparkSession, value):
    """``SparkContext.broadcast`` when available (classic sessions)."""
    try:
        return spark.sparkContext.broadcast(value)
    except Exception:
        return _Shipped(value)


def cores(spark: SparkSession, default: int = 8) -> int:
    """Total task slots of the cluster (default parallelism)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:
        return int(spark.conf.get("spark.sql.shuffle.partitions", str(default)))


def num_partitions(df) -> int | None:
    """Partitions of a DataFrame's plan, None where not observable."""
    try:
        return df.rdd.getNumPartitions()
    except Exception:
        return None
