"""Helpers that the operators of this subpackage share.

Words are maximal runs of characters other than the six ASCII white-space
characters; ``bytes.split()`` cuts at exactly those, ``bytes.lower()`` lowers
exactly A-Z, so UTF-8 bytes are used where a task handles words in Python.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Odd multipliers of 64-bit hash mixing (golden ratio and two primes).
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

#: Paths that ``written`` made within the innermost ``scratch``.
_MADE: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset and the session is local, one of our own; a cluster needs the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def put(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    made, path = put(df, name)
    if _MADE:
        _MADE[-1].append(path)
    return made


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the tables that ``written`` made within: what is to last must be written elsewhere by then."""
    _MADE.append([])
    try:
        yield _MADE[-1]
    finally:
        for path in _MADE.pop():
            removed(spark, path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches (Spark bounds their bytes) in slices of ``rows`` rows, so that what a task makes of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Arrow batches of ``size`` for what is written within: executors hold several of each task's. The caller's setting returns after."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def fold(doc_id: str | Column, of: int) -> Column:
    """crc32 of the id as text, mod ``of``."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % of


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of parallel arrays of 64-bit hashes; the order counts."""
    with np.errstate(over="ignore"):
        h = np.full(len(parts[0]), np.uint64(MIX[2]))
        for p in parts:
            h = (h ^ p) * np.uint64(MIX[0])
            h ^= h >> np.uint64(29)
        h *= np.uint64(MIX[1])
        return h ^ (h >> np.uint64(32))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of the words whose hashes are h."""
    return mixed(*(h[i : len(h) - n + 1 + i] for i in range(n))) if len(h) >= n else h[:0]


def settled_labels(labels: DataFrame, column: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label 0/1) of the documents whose labels agree; null ids or labels count for nothing."""
    at = labels.where(F.col(doc_id).isNotNull() & F.col(column).isin(0, 1)).groupBy(doc_id)
    seen = at.agg(F.min(column).cast("int").alias("label"), F.max(column).cast("int").alias("_top"))
    return seen.where("label = _top").select(F.col(doc_id).alias("doc_id"), "label")


def bounded_sample(rows: DataFrame, bound: int, key: str = "doc_id", seed: int = 11) -> DataFrame:
    """About ``bound`` rows at most, by a hash of the key: all of fewer rows, the same ones each time."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * bound / n))
