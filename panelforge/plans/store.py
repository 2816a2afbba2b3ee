"""Views that many queries share, written once a session and folder of tables, and read by each."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PATHS: dict[tuple[str, str, str], tuple[str, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only in a local session without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _signature(spark: SparkSession, sf_dir: str) -> str:
    """The folder's tables with their sizes and times: a rewritten table gives another one."""
    fs, at = _files(spark, sf_dir)
    return " ".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(at)))


def _removed(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)


def _clear(spark: SparkSession) -> None:
    """Deletes the views at the program's end, where the session is still there."""
    with contextlib.suppress(Exception):
        for path in _PATHS.values():
            _removed(spark, path[1])
    _PATHS.clear()


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The view ``name`` of a folder's tables: built and written by the first query that asks, read by the others; anew where a table has changed since."""
    key, signature = (spark.sparkContext.applicationId, sf_dir, name), _signature(spark, sf_dir)
    seen, path = _PATHS.get(key, (None, None))
    if seen == signature:
        fs, at = _files(spark, f"{path}/_SUCCESS")
        if fs.exists(at):
            return spark.read.parquet(path)
    if not _PATHS:
        atexit.register(_clear, spark)
    made = fresh(spark, f"view-{name}")
    build().write.parquet(made)
    _PATHS[key] = (signature, made)
    if path:
        _removed(spark, path)
    return spark.read.parquet(made)
