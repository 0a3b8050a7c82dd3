"""Tables that a plan writes once and reads several times, in the folder that all executors share."""

from __future__ import annotations

import atexit
import functools
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PATHS: list[tuple[SparkSession, str]] = []
#: Whether a statement deletes the files of its shuffles when it ends; of each session, how many writes want that now and what it was before.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING: dict[int, tuple[int, str]] = {}
_LOCK = threading.Lock()


def root(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset a temporary folder serves in local mode; a cluster has to set it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local()


@functools.cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="leafstack-")


def folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path; what is written there is deleted when the process ends, unless ``keep``."""
    path = f"{root(spark)}/leafstack/{uuid.uuid4().hex}/{name}"
    if not keep:
        _PATHS.append((spark, path))
    return path


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Writes in here delete the files of their shuffles when they end, and not when the driver next collects garbage."""
    key = spark._jsparkSession.hashCode()
    with _LOCK:
        open_, before = _FREEING.get(key, (0, None))
        _FREEING[key] = open_ + 1, before if open_ else spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            open_, before = _FREEING.pop(key)
            if open_ > 1:
                _FREEING[key] = open_ - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: later plans read it instead of computing it again, also after the loss of an executor."""
    path = folder(df.sparkSession, name)
    with freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._leafstack_scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete written tables that no plan reads any more."""
    for t in tables:
        if path := getattr(t, "_leafstack_scratch", None):
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p.getParent(), True)


def clear() -> None:
    while _PATHS:
        try:
            _delete(*_PATHS.pop())
        except Exception:  # noqa: BLE001  the session may already be gone
            return


atexit.register(clear)
