"""Session for tests and benches, and the folder shared by all executors."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("veilframe")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that all executors reach; it goes when the driver's process ends.

    It lies under ``spark.checkpoint.dir``. Only on a local master, where every folder
    is shared, that may be unset; then the session's warehouse takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        base = spark.conf.get("spark.sql.warehouse.dir", None)
    path = f"{base.rstrip('/')}/veilframe/{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # the session is gone already; a local master's folder can still be dropped
        if "://" not in path:
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)
