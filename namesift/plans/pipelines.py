"""Whole runs: detection, import scans, splits, dataset builds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesift.functions import imports, packages
from namesift.functions.text import sanitize
from namesift.operators import align, classify, contrastive, masks, records, report, split


def detect_packages(code: DataFrame, mode_1: DataFrame, mode_2: DataFrame, whitelist: DataFrame, false_positives: DataFrame | None, words: packages.Words, dataset: str = "all") -> tuple[DataFrame, DataFrame]:
    """(results, totals) of one dataset: prompts, answers and both answers about packages by row number. The results are computed once each time they are read; write them before reading twice."""
    merged = sanitize(align.merge_prompts_and_packages(code, mode_1, mode_2))
    x = classify.package_search(merged, "row_id", whitelist, false_positives, words)
    x = classify.pip_numbers(x, "row_id", whitelist)
    return x, report.list_totals(x.withColumn("dataset", F.lit(dataset)), by="dataset")


def detect_datasets(datasets: dict[str, tuple[DataFrame, DataFrame, DataFrame]], whitelist: DataFrame, false_positives: DataFrame | None, words: packages.Words) -> tuple[DataFrame, DataFrame]:
    """(results with dataset, totals by dataset and in all): all datasets in one plan, so that each list is joined once."""
    parts = [sanitize(align.merge_prompts_and_packages(*frames)).withColumns({"dataset": F.lit(name), "__key": F.concat(F.lit(f"{name}|"), F.col("row_id").cast("string"))}) for name, frames in datasets.items()]
    x = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    x = classify.pip_numbers(classify.package_search(x, "__key", whitelist, false_positives, words), "__key", whitelist).drop("__key")
    return x, report.list_totals(x, by="dataset")


def detect_legacy(df: DataFrame, model: str, whitelist: DataFrame, false_positives: DataFrame | None = None, language: str = "Python") -> DataFrame:
    """Result rows (row_id, Answers, Test_1, Test_2) by the older parser with the steps of the model's family."""
    pre, post, style = packages.steps_for(model, language)
    x = df.withColumns({c: packages.split_legacy(F.coalesce(F.col(c), F.lit("")), style, pre, post) for c in ("Test_1", "Test_2")})
    x = classify.package_search(x, "row_id", whitelist, false_positives, extract=False)
    return classify.pip_numbers(x, "row_id", whitelist)


def score_completions(completions: DataFrame, whitelist: DataFrame, false_positives: DataFrame | None, words: packages.Words) -> DataFrame:
    """Completions (row_index, mode, completion) with their names under the slots of their mode. Fails where a column that is needed lacks."""
    lacking = {"mode", "system_prompt", "user_prompt", "completion"} - set(completions.columns)
    if lacking:
        raise ValueError(f"columns that lack: {sorted(lacking)}")
    x = packages.extract_packages(completions, "completion", "names", words)
    x = classify.check_packages(x, "row_index", {"names": ("names", "valid", "hallucinated")}, whitelist, false_positives)
    return align.into_slots(x).drop("names", "valid", "hallucinated")


def scan_master(master: DataFrame, whitelist: DataFrame, false_positives: DataFrame | None = None, answers: str = "Answers") -> tuple[DataFrame, DataFrame]:
    """(prompt, import_valid, import_hallucinated) of each row, and their sums with the rate."""
    x = classify.classify_imports(master.withColumn("__modules", imports.top_level_imports(F.col(answers))), "row_id", "__modules", whitelist, false_positives)
    out = x.select("row_id", F.col("Prompts").alias("prompt"), "import_valid", "import_hallucinated")
    sums = report.list_totals(out, ("import_valid", "import_hallucinated"))
    return out, sums.withColumn("rate", report.rate(F.col("import_hallucinated"), F.col("import_valid")))


def train_test_split(results: DataFrame, per_file: int = 100, ratio: float = 0.9, seed: int = 42, prompt: str = "Prompts", hallucinated_only: bool = True) -> DataFrame:
    """Result rows with side, by prompts sampled for each file; no prompt is on both sides."""
    x = results.where(records.has_hallucination(results)) if hallucinated_only else results
    text = F.coalesce(F.col(prompt), F.col("Questions")) if "Questions" in x.columns and prompt != "Questions" else F.col(prompt)
    x = x.withColumn("__prompt", text)
    keys = split.unique_prompts(x, "__prompt", "_source_file")
    chosen = split.sample_prompts(keys, per_file, ratio, seed, by="_source_file").select(F.col("_source_file").alias("f"), F.col("prompt").alias("p"), "side")
    from namesift.functions.text import strip

    return x.join(chosen, (F.col("_source_file") == F.col("f")) & (strip(F.col("__prompt")) == F.col("p"))).drop("f", "p", "__prompt")


def build_datasets(results: DataFrame, tokenizer, family: str = "llama3", ratio: float = 0.1, seed: int = 42, max_length: int = 2048, variations: int = 3, test: DataFrame | None = None) -> dict[str, DataFrame]:
    """Records with side, token masks, and contrastive records from result rows."""
    rec = records.extract_records(results)
    parted = split.split_by_prompt(rec, ratio, seed)
    tri = masks.tri_mask(parted, tokenizer, family, max_length).join(parted.select(F.col("sample_id").alias("id"), "side"), "id")
    return {"records": parted, "tri_mask": tri, "contrastive": contrastive.contrastive(rec.drop("row_id"), None if test is None else records.extract_records(test).drop("row_id"), variations, ratio, seed)}
