"""Session settings and shared scratch space."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(name: str = "cloakwork", cores: str = "*", memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks; a cluster brings its own settings."""
    cpus = "8" if cores == "*" else cores
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder that all executors see, below the one that ``spark.checkpoint.dir`` names.

    A local session without that setting, as in tests, gets one of its own, which goes when the process ends.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or _own_folder(spark.conf.get("spark.master", "local"))
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


# Folders handed out by this process and not released yet.
_made: list[str] = []


@lru_cache(maxsize=1)
def _own_folder(master: str) -> str:
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="cloakwork-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def release(spark: SparkSession) -> None:
    """Delete all scratch folders handed out so far; to be called when no result that rests on them is needed."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(hadoop).delete(path, True)


# Spark's own setting by which a query's shuffle files go when it has ended; what follows reads the written table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to shared scratch space and read it back: what follows starts from the files."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no plan still to run reads."""
    for table in tables:
        place = getattr(table, "_scratch_path", None)
        if place in _made:
            _made.remove(place)
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
