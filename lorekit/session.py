"""Session helpers: one place for the Spark settings every job relies on."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "lorekit", cores: int | str = "*", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster, build the session
    with the cluster's own master and keep the SQL settings below."""
    parts = shuffle_partitions or (8 if cores == "*" else max(int(cores), 1))
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOREKIT_DRIVER_MEMORY", "16g"))
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Only a local master without the setting (tests) gets a scratch folder of our own: on a cluster every
    executor would write to its own disk, so a missing setting is an error there."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        try:
            current = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # noqa: BLE001
            current = None
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="lorekit-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    """A new folder for an intermediate table, in the application's own folder under the shared checkpoint folder.
    Hadoop removes that folder when the application ends; results may read their stages until then."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lorekit-stages/{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where)
    store.deleteOnExit(where)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more. Its cleaner waits for garbage
    collection in the driver, which may be long in coming; call this between the steps of a long job, after their
    tables are written."""
    gc.collect()
    spark._jvm.System.gc()


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a path or glob names, in whatever store Spark reads it from."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return [f.getPath().toString() for f in found or []]


def path_exists(spark: SparkSession, path: str) -> bool:
    return bool(list_paths(spark, path))


def cut_lineage(df):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it
    back: lineage is cut (a lost executor re-reads instead of recomputing) and the
    plan is computed once, where ``DataFrame.checkpoint()`` on an uncached plan
    computes it twice (the action, then the checkpoint write)."""
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)
