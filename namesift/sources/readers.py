"""Scans: result tables, records, prompts, name lists, configuration, vector and result folders."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namesift import schemas
from namesift.functions.text import normalize_python_package, strip

FORGET, RETAIN, VAL = "forget", "retain", "val"


def _list_files(spark: SparkSession, path: str, pattern: str, deep: bool = False) -> list[str]:
    """Files under a folder of any file system by a pattern of their names, sorted."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out, it = [], fs.listFiles(p, deep)
    while it.hasNext():
        f = it.next().getPath()
        if re.fullmatch(pattern, f.getName()):
            out.append(f.toString())
    return sorted(out)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def with_row_id(df: DataFrame, rank: str | None = None, start: int = 0) -> DataFrame:
    """df with row_id: the position over all files, by a rank column if given, file, place of the file's block, and place in it.

    Two counting passes and no global sort: blocks are numbered by a small aggregate, rows inside by their order.
    """
    x = df.withColumns({"__f": F.struct(F.col(rank) if rank else F.lit(0), F.col("_metadata.file_path")), "__b": F.col("_metadata.file_block_start"), "__m": F.monotonically_increasing_id()})
    before = Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = x.groupBy("__f", "__b").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__f", "__b").orderBy("__m")) - 1
    y = x.withColumn("__i", inside).join(F.broadcast(blocks.drop("__n")), ["__f", "__b"])  # one row for each block read
    return y.withColumn("row_id", F.col("__base") + F.col("__i") + start).drop("__f", "__b", "__m", "__i", "__base")


def read_tabular(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines for .json and .jsonl, else CSV whose fields span lines and double their quotes."""
    r = spark.read.schema(schema) if schema else spark.read
    if path.endswith((".json", ".jsonl")):
        return r.json(path)
    return r.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)


def read_results(spark: SparkSession, source: DataFrame | str | list[str]) -> DataFrame:
    """Result rows with _source_file and row_id from a frame, files, a file or a folder.

    Of a folder: files whose names have "results", else all CSV files, else those with "results" below it; never
    FINAL_RESULTS or PACKAGE_NAMES. Of a list, paths that do not exist are passed over. Columns are united by name.
    """
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        if not exists(spark, source):
            raise FileNotFoundError(source)
        if _is_dir(spark, source):
            csv, results = r"(?!.*(FINAL_RESULTS|PACKAGE_NAMES)).*\.csv", r"(?!.*(FINAL_RESULTS|PACKAGE_NAMES)).*results.*\.csv"
            source = _list_files(spark, source, results) or _list_files(spark, source, csv) or _list_files(spark, source, results, True)
        else:
            source = [source]
    else:
        source = [p for p in source if exists(spark, p)]
    if not source:
        raise ValueError("no result files")
    frames = [read_tabular(spark, p).withColumns({"_source_file": F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "__rank": F.lit(i)}) for i, p in enumerate(source)]
    n, out = 0, []
    for f in frames:
        g = with_row_id(f, "__rank", n).drop("__rank")
        out.append(g)
        n += f.count()
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def is_array_file(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file holds one array rather than lines: by its first sign."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    return bool(head) and head[0].lstrip().startswith("[")


def read_records(spark: SparkSession, path: str, split_type: str = "all", modes: tuple[int, ...] = (1, 2), schema: str = schemas.RECORD) -> DataFrame:
    """Records of a JSON array or JSON lines, of these splits and modes; fields that lack get empty values."""
    df = spark.read.schema(schema).json(path, multiLine=is_array_file(spark, path))
    empty = {"string": F.lit(""), "int": F.lit(1), "array<string>": F.array().cast("array<string>"), "array<int>": F.array().cast("array<int>")}
    df = df.select(*(F.coalesce(F.col(c), empty[t]).alias(c) for c, t in df.dtypes))
    splits = [FORGET, RETAIN, VAL] if split_type == "all" else [split_type]
    return df.where(F.col("split_type").isin(splits) & F.col("mode").isin(*modes))


def read_tokenized(spark: SparkSession, path: str, split_type: str = "all", modes: tuple[int, ...] = (1, 2)) -> DataFrame:
    return read_records(spark, path, split_type, modes, schemas.TOKENIZED)


def columns_of(spark: SparkSession, path: str) -> set[str]:
    try:
        return set(spark.read.json(path, multiLine=is_array_file(spark, path)).columns)
    except Exception:  # noqa: BLE001  a file that cannot be read is of no known kind
        return set()


def is_preprocessed(spark: SparkSession, path: str) -> bool:
    return {"sample_id", "split_type"} <= columns_of(spark, path)


def is_tokenized(spark: SparkSession, path: str) -> bool:
    return {"input_ids", "labels"} <= columns_of(spark, path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_token_level(spark: SparkSession, forget: str, retain: str) -> DataFrame:
    """The four arrays of both files with origin; reading fails on arrays that differ in length or unknown masks."""
    from namesift.operators.masks import checked

    cols = ["input_ids", "attention_mask", "labels", "tri_mask"]
    parts = [checked(spark.read.schema(schemas.TRI_MASK).json(p).select(*cols)).withColumn("origin", F.lit(o)) for o, p in ((FORGET, forget), (RETAIN, retain))]
    return parts[0].unionByName(parts[1])


def objects(text: str) -> list[dict]:
    """JSON objects of lines, of an array, or one after another."""
    text, at, out, d = text.strip(), 0, [], json.JSONDecoder()
    if text.startswith("["):
        return json.loads(text)
    while at < len(text):
        x, at = d.raw_decode(text, at)
        out.append(x)
        while at < len(text) and text[at].isspace():
            at += 1
    return out


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files in which objects follow one another without rule; each file is read whole."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"value": [json.dumps(o) for t in pdf["value"] for o in objects(t)]})

    lines = spark.read.text(path, wholetext=True).mapInPandas(run, "value string")
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def read_split(spark: SparkSession, path: str, mode: int) -> DataFrame:
    x = read_objects(spark, path, "mode INT, system_prompt STRING, user_prompt STRING, completion STRING").where(F.col("mode") == mode)
    out = x.select("system_prompt", "user_prompt", "completion")
    if out.isEmpty():
        raise ValueError(f"no rows of mode {mode}")
    return out


def read_strings(spark: SparkSession, path: str, column: str = "prompt") -> DataFrame:
    """JSON lines of bare strings, numbered."""
    y = with_row_id(spark.read.text(path)).where(F.trim("value") != "")
    return y.select("row_id", F.get(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>"), F.lit(0)).alias(column))


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """(name): column 0 of a CSV without header, normalised."""
    return spark.read.schema("name string").csv(path).select(normalize_python_package(F.col("name")).alias("name")).where("name is not null").distinct()


def read_false_positives(spark: SparkSession, path: str, normalize: bool = False) -> DataFrame:
    """(name): column 1 of a CSV without header; as it is, unless asked."""
    x = spark.read.schema("c0 string, name string").csv(path).select("name").where("name is not null")
    return (x.select(normalize_python_package(F.col("name")).alias("name")) if normalize else x).distinct()


def read_name_set(spark: SparkSession, path: str) -> DataFrame:
    """(name): a JSON array as it is, else one name a line, normalised."""
    if path.endswith(".json"):
        return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("name")).distinct()
    return spark.read.text(path).select(normalize_python_package(strip(F.col("value"))).alias("name")).where("name <> ''").distinct()


def finished_prefix(df: DataFrame, value: str = "value") -> DataFrame:
    """Numbered lines before the first that is no JSON: where a run that broke off has come to."""
    bad = df.where(F.try_parse_json(value).isNull()).agg(F.min("row_id").alias("b"))
    x = df.join(F.broadcast(bad), F.col("b").isNull() | (F.col("row_id") < F.col("b")), "left_semi")
    return x


def section(config: dict, name: str) -> dict:
    """A part of nested settings by its dotted name; empty where it lacks."""
    for k in name.split("."):
        config = config.get(k, {}) if isinstance(config, dict) else {}
    return config if isinstance(config, dict) else {}


def settings(config: dict, sections: list[str]) -> dict[str, str]:
    """CFG_NAME -> text of plain values; later sections override earlier ones, names with a leading underscore and nested values are left out."""
    out = {}
    for s in sections:
        for k, v in section(config, s).items():
            if not k.startswith("_") and isinstance(v, (str, int, float, bool)):
                out[f"CFG_{re.sub(r'[^A-Za-z0-9]', '_', k).upper()}"] = str(v).lower() if isinstance(v, bool) else str(v)
    return out


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def vector_layers(spark: SparkSession, folder: str, suffix: str, targets: list[int] | None = None) -> list[int]:
    """Layers that have a vector file or partition, sorted; only those among targets where given."""
    names = _list_files(spark, folder, rf".*layer[_=]?(\d+).*{re.escape(suffix)}.*")
    found = {int(m.group(1)) for n in names if (m := re.search(r"layer[_=]?(\d+)", n.rsplit("/", 1)[-1]))}
    return sorted(found & set(targets) if targets is not None else found)


def matching_results(names: list[str], wanted: dict[str, object | None]) -> list[str]:
    """File names that hold every set key=value and no key= that is unset."""
    return [n for n in names if all((f"{k}={v}" in n) if v is not None else (f"{k}=" not in n) for k, v in wanted.items())]
