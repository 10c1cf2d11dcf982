"""Rows by position: numbering, positional merges, paired batches, layer pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranges(df: DataFrame, key: str, parts: int | None) -> Column:
    """The number of the range of a numeric key that a row is in: cut at approximate quantiles, nulls in range 0."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    known = df.where(F.col(key).isNotNull() & ~F.isnan(F.col(key).cast("double")))
    cuts = sorted(set(known.stat.approxQuantile(key, [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    at = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(key) >= c)) + 1 if cuts else F.lit(1), F.lit(0))
    return F.when(F.col(key).isNull(), 0).otherwise(at)


def sums_before(df: DataFrame, key: str, value: Column, out: str, by: list[str] = [], parts: int | None = None) -> DataFrame:  # noqa: B006
    """df with out: the sum of value over the rows of a group that come before, in the order of a numeric key; ties in any order.

    No task sees all rows of a group: rows are dealt out by ranges of the key, each range is added up, the few sums of a
    group's ranges lie in one array and are added up there, and only rows of one range and group are ordered.
    """
    x = df.withColumns({"__range": _ranges(df, key, parts), "__value": value})
    sums = x.groupBy(*by, "__range").agg(F.sum("__value").alias("__s"))
    rows = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__range", "__s"))).alias("__a"))  # one item a range
    total = lambda items: F.aggregate(items, F.lit(0).cast(sums.schema["__s"].dataType), lambda t, i: t + F.coalesce(i["__s"], F.lit(0)))
    each = F.transform("__a", lambda i, k: F.struct(i["__range"].alias("__r"), total(F.slice("__a", F.lit(1), k)).alias("__base")))
    base = rows.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.inline(each))
    inside = F.sum("__value").over(Window.partitionBy(*by, "__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    same = F.col("__range") == F.col("__r")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{i}"))
    y = x.withColumn("__inside", inside).join(base, same)
    return y.withColumn(out, F.col("__base") + F.coalesce("__inside", F.lit(0))).drop("__range", "__value", "__inside", "__r", "__base", *(f"__by{i}" for i in range(len(by))))


def row_numbers(df: DataFrame, key: str, out: str, parts: int | None = None) -> DataFrame:
    """df with out: the number of each row from 0 in the order of a numeric key; ties in any order.

    No task sees all rows: ranges of the key are cut at approximate quantiles, counted, and numbered each by itself.
    """
    return sums_before(df, key, F.lit(1).cast("long"), out, parts=parts)


def positional_merge(frames: dict[str, DataFrame], key: str = "row_id") -> DataFrame:
    """One row for each row number of any frame; columns missing on one side are null. Of columns of one name the later stays."""
    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.drop(*(c for c in b.columns if c != key)).join(b, key, "full")

    return reduce(join, frames.values())


def merge_prompts_and_packages(code: DataFrame, mode_1: DataFrame, mode_2: DataFrame, response: str = "response", key: str = "row_id") -> DataFrame:
    """The code's rows with the two answers about packages as Test_1 and Test_2."""
    answers = [f.select(key, F.col(response).alias(f"Test_{i}")) for i, f in ((1, mode_1), (2, mode_2))]
    return code.drop("Test_1", "Test_2").join(answers[0], key, "full").join(answers[1], key, "full")


def combine_code_and_prompt(prompts: DataFrame, answers: DataFrame, prompt_col: str = "Prompts", key: str = "row_id") -> DataFrame:
    """(row_id, Prompts or Questions, Answers) from one unnamed column each."""
    own = lambda d: next(c for c in d.columns if c != key)
    return prompts.select(key, F.col(own(prompts)).alias(prompt_col)).join(answers.select(key, F.col(own(answers)).alias("Answers")), key, "full")


def merge_completions(original: DataFrame, completions: DataFrame, key: str = "row_index") -> DataFrame:
    """Original rows under names ending in _original where the completions have columns of the same name, beside their completions."""
    same = [c for c in original.columns if c in completions.columns and c != key]
    x = original.withColumnsRenamed({c: f"{c}_original" for c in same})
    return x.join(completions, key, "left")


def into_slots(df: DataFrame, names: str = "names", valid: str = "valid", hallucinated: str = "hallucinated", mode: str = "mode") -> DataFrame:
    """The lists of a row under Test_k, valid_k and hallucinated_k of its mode k; the other mode's stay null, unknown modes keep none."""
    cols = {f"{out}_{k}": F.when(F.col(mode) == k, F.col(c)) for k in (1, 2) for out, c in (("Test", names), ("valid", valid), ("hallucinated", hallucinated))}
    return df.withColumns(cols)


def paired_batches(forget: DataFrame, retain: DataFrame, size: int, cycle: bool = True, key: str = "row_id") -> DataFrame:
    """(step, side, row) of batches that go side by side: the shorter side starts over, or both stop with it."""
    numbered = {s: row_numbers(d, key, "__i").select((F.col("__i") / size).cast("long").alias("batch"), F.struct(*d.columns).alias("row")) for s, d in (("forget", forget), ("retain", retain))}
    n = {s: (d.agg(F.max("batch")).first()[0] or -1) + 1 if d.head(1) else 0 for s, d in numbered.items()}
    steps = max(n.values()) if cycle else min(n.values())
    if not all(n.values()):
        steps = 0
    at = forget.sparkSession.range(steps).withColumnRenamed("id", "step")
    parts = [at.withColumn("batch", F.col("step") % max(1, n[s])).join(d, "batch").select("step", F.lit(s).alias("side"), "row") for s, d in numbered.items()]
    return parts[0].unionByName(parts[1], allowMissingColumns=True) if parts[0].schema == parts[1].schema else parts[0].withColumn("row", F.to_json("row")).unionByName(parts[1].withColumn("row", F.to_json("row")))


def layer_pairs(layers: DataFrame, which: str = "adjacent") -> DataFrame:
    """(layer_from, layer_to): neighbours among the layers at hand, all rising pairs, or those named as "0-1,3-7"."""
    x = layers.select("layer").distinct()
    if which == "adjacent":
        w = Window.orderBy("layer")
        return x.select(F.col("layer").alias("layer_from"), F.lead("layer").over(w).alias("layer_to")).where("layer_to is not null")
    pairs = x.select(F.col("layer").alias("layer_from")).join(x.select(F.col("layer").alias("layer_to")), F.col("layer_from") < F.col("layer_to"))
    if which == "all":
        return pairs
    named = list(dict.fromkeys(tuple(map(int, p.strip().split("-"))) for p in which.split(",") if p.strip()))
    asked = layers.sparkSession.createDataFrame(named, "layer_from int, layer_to int")
    return asked.join(x.select(F.col("layer").alias("layer_from")), "layer_from", "left_semi").join(x.select(F.col("layer").alias("layer_to")), "layer_to", "left_semi")
