"""Labelled answers for separator vectors: hallucinated (0) against truthful (1) samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesift.functions import lists, prompts
from namesift.operators.records import unpivot_modes
from namesift.operators.split import balanced_partition


def samples(results: DataFrame) -> DataFrame:
    """(sample_id, mode, system_prompt, prompt, answer, label): 0 where a mode has hallucinated names, 1 where it has valid names alone; others none."""
    x = unpivot_modes(results)
    label = F.when(F.size("hall") > 0, 0).when(F.size("valid") > 0, 1)
    pick = lambda d: F.when(F.col("mode") == 1, d[1]).otherwise(d[2])
    answer = lists.format_packages(F.when(F.size("test") > 0, F.col("test")).otherwise(F.concat("valid", "hall")))
    sid = F.concat("_source_file", F.lit("_m"), F.col("mode").cast("string"), F.lit("_idx"), F.col("row_id").cast("string"))
    return x.select(sid.alias("sample_id"), "mode", pick(prompts.SYSTEM).alias("system_prompt"), F.concat(pick(prompts.PREFIX), F.lit(" "), F.col("content")).alias("prompt"), answer.alias("answer"), label.alias("label")).where("label is not null")


def partition(df: DataFrame, exemplars: int = 32, wild_ratio: float = 0.75, seed: int = 42) -> DataFrame:
    return balanced_partition(df, "sample_id", "label", exemplars, wild_ratio, seed)
