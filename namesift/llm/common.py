"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition used throughout: \x20 and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch handed to Python, so that a batch of long texts stays small.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees; a temporary one where that is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = tempfile.mkdtemp(prefix="namesift-")
        atexit.register(shutil.rmtree, path, True)
        root = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str, by: str | None = None, dictionary: int = 0) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    With `by`, the rows of each value of that column lie in a folder of their own, which discard() can delete alone.
    With `dictionary`, values that recur are written once for each file, up to so many bytes of them (Parquet: 1 MB).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write = df.write.option("parquet.dictionary.page.size", dictionary) if dictionary else df.write
    (write.partitionBy(by) if by else write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._namesift_path = path
    return out


def discard(df: DataFrame, part: str = "") -> None:
    """Delete a table that materialise() wrote, or one folder ("column=value") of it, that nothing reads any more."""
    spark, path = df.sparkSession, f"{df._namesift_path}/{part}".rstrip("/")
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of one Arrow batch: whole texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over now, and not when the driver next happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def id_remainder(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))), F.lit(n)).cast("int")
