"""Dataset folders of Arrow files, as dataset libraries save them: one partition a file, only the columns asked for."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAME = "arrow_folder"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path: local without a scheme, else by the scheme (hdfs, s3, gs, file and what else pyarrow knows)."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _there(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type == pafs.FileType.File


def _json(fs: pafs.FileSystem, path: str) -> dict:
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def _batches(fs: pafs.FileSystem, path: str) -> pa.RecordBatchReader:
    """A file's batches; files of streams and of Arrow's file format are told apart by their first signs."""
    f = fs.open_input_file(path)
    head = f.read(6)
    f.seek(0)
    if head == b"ARROW1":
        r = pa.ipc.open_file(f)
        return pa.RecordBatchReader.from_batches(r.schema, (r.get_batch(i) for i in range(r.num_record_batches)))
    return pa.ipc.open_stream(f)


def files(path: str, split: str | None = None) -> list[str]:
    """Full paths of a folder's files in order: as its state lists them, else by name; of a folder of splits those of one or of all."""
    fs, root = _open(path.rstrip("/"))
    if _there(fs, f"{root}/dataset_dict.json"):
        known = _json(fs, f"{root}/dataset_dict.json")["splits"]
        if split is not None and split not in known:
            raise ValueError(f"no split {split} among {known}")
        return [f for s in ([split] if split is not None else known) for f in files(f"{path.rstrip('/')}/{s}")]
    if split is not None:
        raise ValueError("a folder without splits")
    if _there(fs, f"{root}/state.json"):
        names = [d["filename"] for d in _json(fs, f"{root}/state.json")["_data_files"]]
    else:
        names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.extension == "arrow")
    return [f"{path.rstrip('/')}/{n}" for n in names]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str]):
        self.names, self.schema, self.paths = schema.names, to_arrow_schema(schema), paths

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, path = _open(partition.path)
        for b in _batches(fs, path):
            own = pa.Table.from_batches([b.select(self.names)]).cast(self.schema)
            yield from own.to_batches(max_chunksize=4096)


class ArrowFolder(DataSource):
    """spark.read.format("arrow_folder"); options: path, split, columns (divided by commas; all without)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _files(self) -> list[str]:
        return files(self.options["path"], self.options.get("split"))

    def schema(self) -> StructType:
        found = self._files()
        if not found:
            raise ValueError(f"no Arrow files in {self.options['path']}")
        whole = from_arrow_schema(_batches(*_open(found[0])).schema)
        asked = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([whole[c] for c in asked]) if asked else whole

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self._files())


def read_arrow_folder(spark: SparkSession, path: str, columns: list[str] | None = None, split: str | None = None) -> DataFrame:
    """Rows of a saved dataset: one partition a file, of which only the columns asked for are taken.

    path must be on a file system that all executors reach. Files of one dataset have one schema; the first one's is
    taken. A dataset without files is an error, files without rows give none.
    """
    spark.dataSource.register(ArrowFolder)
    r = spark.read.format(NAME).option("path", path)
    r = r.option("columns", ",".join(columns)) if columns else r
    return (r.option("split", split) if split is not None else r).load()
