"""Sinks. Parquet is canonical; text formats are exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from namesift.sources import folders


#: Files of an ordered table: their names are in order up to so many.
MOST_FILES = 99_999


def as_text(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, for formats without them."""
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (ArrayType, StructType)) else F.col(f"`{f.name}`") for f in df.schema))


def save_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path, ignoreNullFields=False)


def save_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    (df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)).parquet(path)


def save_csv(df: DataFrame, path: str, mode: str = "error", single: bool = False) -> None:
    """All fields quoted, lists as JSON."""
    (as_text(df).coalesce(1) if single else as_text(df)).write.mode(mode).csv(path, header=True, quoteAll=True, escape='"', lineSep="\n")


def save_ordered(df: DataFrame, path: str, order: list[str], kind: str = "json", by: list[str] | None = None, files: int | None = None, mode: str = "error") -> None:
    """Rows so that files read in the order of their names are in the order of `order`; nulls first.

    Rows are dealt out by ranges of the order and sorted inside: no task has more than its range. by: columns that name
    folders; each folder's files are in order. kind: json, parquet or csv.
    """
    n = min(MOST_FILES, files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    keys = [*(by or []), *order]
    x = (as_text(df) if kind == "csv" else df).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    options = {"json": {"ignoreNullFields": False}, "csv": {"header": True, "quoteAll": True, "escape": '"', "lineSep": "\n"}}.get(kind, {})
    w = x.write.mode(mode).format(kind).options(**options)
    (w.partitionBy(*by) if by else w).save(path)


def save_tokenized(records: DataFrame, path: str, tokenizer, family: str = "llama3", max_length: int = 2048, mode: str = "error") -> None:
    """Six fields, tokenised first where needed."""
    from namesift.operators.records import pointwise

    x = records if "input_ids" in records.columns else pointwise(records, tokenizer, family, max_length)
    save_jsonl(x.select("sample_id", "split_type", "mode", "input_ids", "attention_mask", "labels"), path, mode)


def save_results(results: DataFrame, totals: DataFrame, path: str, mode: str = "error") -> None:
    """results, FINAL_RESULTS (totals) and PACKAGE_NAMES (results without prompts, answers and raw lists) under path."""
    save_csv(results, f"{path}/results", mode)
    save_csv(totals, f"{path}/FINAL_RESULTS", mode, True)
    save_csv(results.drop("Prompts", "Questions", "Answers", "Test_1", "Test_2"), f"{path}/PACKAGE_NAMES", mode)


def save_report(rates: DataFrame, contexts: DataFrame, path: str, mode: str = "error") -> None:
    save_csv(rates, f"{path}/table1_hallucination_rate", mode, True)
    save_csv(contexts, f"{path}/table1_by_context", mode, True)


def save_split(df: DataFrame, metadata: DataFrame, path: str, mode: str = "error") -> None:
    """Rows by side, the test prompts, and counts."""
    save_parquet(df, f"{path}/rows", ["side"], mode)
    save_jsonl(df.where("side = 'test'").select("Prompts"), f"{path}/test_prompts", mode)
    save_jsonl(metadata, f"{path}/split_metadata", mode)


def save_contrastive(df: DataFrame, path: str, mode: str = "error") -> dict[str, DataFrame]:
    """Written once by part and kind, in order where there is an order; returned by the names of the variants: original, shuffled (also augmented) and all of each part."""
    x = df.withColumn("variant", F.when(F.col("is_shuffled_variation"), "shuffled").otherwise("original"))
    if "order" in df.columns:
        save_ordered(x, path, ["order", "sample_id"], "parquet", ["part", "variant"], mode=mode)
    else:
        save_parquet(x, path, ["part", "variant"], mode)
    y = df.sparkSession.read.parquet(path)
    out = {}
    for part in ("train", "val", "test"):
        own = y.where(F.col("part") == part)
        out |= {f"{part}_all": own, f"{part}_original": own.where("variant = 'original'"), f"{part}_shuffled": own.where("variant = 'shuffled'")}
        out[f"{part}_augmented"] = out[f"{part}_shuffled"]
    return out


def save_vectors(vectors: DataFrame, path: str, mode: str = "error") -> None:
    save_parquet(vectors, path, ["layer"], mode)


def save_bundle(spark: SparkSession, vectors: DataFrame, settings: dict, path: str, mode: str = "error") -> None:
    """Steering vectors with the settings they were chosen for."""
    save_vectors(vectors, f"{path}/vectors", mode)
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/config")


def save_benchmarks(samples: DataFrame, scores: dict[str, dict[str, float]], model: str, checkpoint: str, path: str) -> None:
    """Solutions and scores of a model's benchmarks under path, all at once or not at all.

    samples: (benchmark, task_id, solution) and an optional position among a task's solutions. Each benchmark gets
    MODEL_BENCHMARK_samples.jsonl, a folder of lines (task_id, solution) by task and position; the scores, with model
    and checkpoint, lie in MODEL_evalplus_summary.json. Benchmarks come from the scores. A path that is there is an
    error; so are samples of a benchmark without scores.
    """
    spark = samples.sparkSession
    found = {r[0] for r in samples.select("benchmark").distinct().limit(len(scores) + 1).collect()}
    if not found <= set(scores):
        raise ValueError(f"samples of benchmarks without scores: {sorted(map(str, found - set(scores)))}")
    order = ["task_id", "position"] if "position" in samples.columns else ["task_id", "solution"]
    summary = json.dumps({"model": model, "checkpoint": checkpoint, "scores": scores}, indent=2)

    def write(to: str) -> None:
        for name in scores:
            own = samples.where(F.col("benchmark") == name).repartitionByRange(*order).sortWithinPartitions(*order)
            own.select("task_id", "solution").write.json(f"{to}/{model}_{name}_samples.jsonl", ignoreNullFields=False)
        spark.createDataFrame([(summary,)], "value string").coalesce(1).write.text(f"{to}/{model}_evalplus_summary.json")

    folders.publish(spark, path, write)
