"""Long runs that go on where they broke off: finished batches with their keys, and what is left to do.

A batch is a folder batch=ID with rows and their keys, published by one rename; the folders are only ever added to. A
run that breaks off leaves no batch, or a whole one, so a key is finished exactly if its rows can be read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from namesift.sources import folders


def _batches(spark: SparkSession, path: str) -> list[str]:
    return folders.children(spark, path, "batch=")


def append(rows: DataFrame, path: str, key: str) -> str:
    """Add a batch of finished rows; its id. Rows are computed once: their keys are read from what was written."""
    spark, batch = rows.sparkSession, uuid.uuid4().hex

    def write(to: str) -> None:
        rows.write.parquet(f"{to}/rows")
        spark.read.schema(rows.schema).parquet(f"{to}/rows").select(key).distinct().write.parquet(f"{to}/keys")

    folders.publish(spark, f"{path.rstrip('/')}/batch={batch}", write)
    return batch


def finished_keys(spark: SparkSession, path: str, like: DataFrame, key: str) -> DataFrame:
    """(key) of all finished batches; none where nothing is there yet."""
    found = _batches(spark, path)
    own = like.select(key)
    return spark.read.schema(own.schema).parquet(*(f"{path.rstrip('/')}/{b}/keys" for b in found)).distinct() if found else own.limit(0)


def pending(todo: DataFrame, path: str, key: str) -> DataFrame:
    """Rows of todo whose key no finished batch has; rows without a key are never finished."""
    return todo.join(finished_keys(todo.sparkSession, path, todo, key), key, "left_anti")


def read_finished(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All rows of finished batches."""
    found = _batches(spark, path)
    if not found:
        raise FileNotFoundError(f"no finished batches in {path}")
    r = spark.read.schema(schema) if schema else spark.read
    return r.parquet(*(f"{path.rstrip('/')}/{b}/rows" for b in found))
