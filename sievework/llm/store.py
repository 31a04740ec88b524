"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Where the tables lie that ``written`` has returned.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and all executors
    are threads of this process, as in tests. A cluster must name the folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own:
        folder = tempfile.TemporaryDirectory(prefix="sievework-", ignore_cleanup_errors=True)
        atexit.register(folder.cleanup)
        _own["dir"] = f"file://{folder.name}"
    return _own["dir"]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/sievework/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None, *, gathered: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage is cut, and what it holds
    survives the loss of any executor. ``gathered``: many tasks make few rows, which go to files of a
    sensible size by one more, small, shuffle."""
    spark = df.sparkSession
    df = df.hint("rebalance") if gathered else df
    path = path or scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    _paths[back := spark.read.schema(df.schema).parquet(path)] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            drop(df.sparkSession, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table by Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
