"""Folders that become visible whole or not at all, on any file system that Spark reaches: one rename publishes them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str, start: str = "") -> list[str]:
    """Names in a folder that begin with `start`, sorted; none of a folder that is not there."""
    fs, p = _fs(spark, path)
    return sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith(start)) if fs.exists(p) else []


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let write() fill a folder beside `path` and rename that to `path`.

    Tasks that fail leave nothing but their own attempts, which the committer drops; a run that fails, or finds that
    `path` has come to be there, deletes what it wrote. What a run that was killed leaves is named _attempt-... and is
    read by nothing.
    """
    parent, _, name = path.rstrip("/").rpartition("/")
    attempt = f"{parent}/_attempt-{uuid.uuid4().hex}-{name}"
    fs, a = _fs(spark, attempt)
    if exists(spark, path):
        raise FileExistsError(path)
    try:
        write(attempt)
        # a rename to a folder that is there would move this one into it
        if exists(spark, path) or not fs.rename(a, _fs(spark, path)[1]):
            raise FileExistsError(path)
    except BaseException:
        fs.delete(a, True)
        raise
