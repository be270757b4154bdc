"""Shared plumbing of the training-data operators: tables, shared storage, workers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Words as the quality rules define them: runs without space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers: list[tuple[str, ...]] = []  # the settings before the first of the writes that run now
#: Settings of a write of :func:`materialize`: shuffle files go at its end, and Python workers
#: get few rows at a time, since a row is a document.
_SETTINGS = {_CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Where that is unset (tests), a local folder is used, in local mode only: executors
    of a cluster would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/spindrift-checkpoints"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder.

    Shuffle files of the write are removed as soon as it ends, so that disk holds the
    table and not what led to it. The table goes with :func:`release`, or when the driver ends.
    """
    spark = df.sparkSession
    path = work_dir(spark, tag)
    with _lock:  # writes of several threads share the settings
        _writers.append(_writers[0] if _writers else tuple(spark.conf.get(k) for k in _SETTINGS))
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        with _lock:
            before = _writers.pop()
            if not _writers:
                for k, v in zip(_SETTINGS, before):
                    spark.conf.set(k, v)
    for made in _scopes:
        made.append(path)
    p, fs = _file_system(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._spindrift_path = path
    return out


def _file_system(spark: SparkSession, path: str):
    """A path and its file system, in the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the end what :func:`materialize` wrote inside, but for paths taken from the list."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
        for path in made:
            _delete(spark, path)


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_spindrift_path", None):
            _delete(df.sparkSession, path)


_caches: dict[str, dict] = {}


def claim(owner: str, cache: dict | None = None) -> None:
    """Called in a Python worker by the operator that works now: what other operators hold in
    this worker goes, so that a worker holds the cache of one operator."""
    for name, held in _caches.items():
        if name != owner:
            held.clear()
    if cache is not None:
        _caches[owner] = cache


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts with about ``limit`` characters each, one text at least."""
    i = total = 0
    for j, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield i, j + 1
            i, total = j + 1, 0
    if i < len(texts):
        yield i, len(texts)
