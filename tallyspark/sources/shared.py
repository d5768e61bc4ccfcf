"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="tallyspark-")
        base = f"file://{_own_dirs[app]}"
    return f"{base.rstrip('/')}/tallyspark-{app}"


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below spark.checkpoint.dir. Where that is unset, below a folder made here if Spark runs in one process (tests, a laptop), else an error."""
    return f"{_base(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, so that lost executors cost no rework.

    Tables stay until ``clear``, as results may read them, or until ``discard``.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def at_hand(df: DataFrame) -> DataFrame:
    """The table, stored unless it is already."""
    return df if df in _paths else stored(df)


def stored_all(*frames: DataFrame) -> list[DataFrame]:
    """Several tables that don't depend on each other, written at the same time, so that small ones don't wait in turn."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(at_hand, frames))


#: While large tables are made one after the other: an action's shuffle files go when it ends, not when the driver next collects garbage.
_TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
_tidy_lock = threading.Lock()
_tidy_before: dict[str, list] = {}


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, ``stored`` tables are packed tighter and actions leave no shuffle files behind. May be nested and used by several threads; the session's settings are as before once the last is out."""
    app = spark.sparkContext.applicationId
    with _tidy_lock:
        if app not in _tidy_before:
            _tidy_before[app] = [0, {k: spark.conf.get(k, None) for k in _TIDY}]
            for k, v in _TIDY.items():
                spark.conf.set(k, v)
        _tidy_before[app][0] += 1
    try:
        yield
    finally:
        with _tidy_lock:
            _tidy_before[app][0] -= 1
            if not _tidy_before[app][0]:
                for k, v in _tidy_before.pop(app)[1].items():
                    spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Deletes ``stored`` tables that nothing reads any more; what was derived from them must have been stored itself."""
    for df in frames:
        path = _paths.pop(df, None)
        if path:
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables. For the end of a job: results that still read them are lost."""
    _delete(spark, _base(spark))
