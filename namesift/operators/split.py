"""Reproducible samples and leak-free splits: order by md5 of seed and key takes the place of a random generator."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesift.functions.text import strip

#: Groups that are shuffled in one place where the generator's own order is asked for; more are an error.
PYTHON_KEYS = 100_000


def order_key(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_head(keys: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n keys that come first in the order of their hashes, and no global sort for it.

    Keys are counted by the first 16 bits of the hash; whole buckets below the last one are in, and only that bucket
    is sorted.
    """
    x = keys.withColumn("__h", order_key(seed, F.col(key))).withColumn("__b", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"))
    left, cut = n, -1
    for b, k in sorted(map(tuple, x.groupBy("__b").count().collect())):  # at most 65536 rows
        cut = b
        if k >= left:
            break
        left -= k
    below = x.where(F.col("__b") < cut)
    last = x.where(F.col("__b") == cut).orderBy("__h", key).limit(max(0, left))
    return below.unionByName(last).drop("__h", "__b")


def unique_prompts(df: DataFrame, prompt: str = "Prompts", by: str | None = None) -> DataFrame:
    """Distinct stripped prompts with the number of their first row, for each value of `by`."""
    x = df.where(F.col(prompt).isNotNull()).withColumn("prompt", strip(F.col(prompt)))
    return x.groupBy(*([by] if by else []), "prompt").agg(F.min("row_id").alias("row_id"))


def sample_prompts(keys: DataFrame, n: int, ratio: float, seed: int = 42, key: str = "prompt", by: str | None = None) -> DataFrame:
    """n keys for each value of `by` in random order, with side: train for the first int(n * ratio), test for the others. Fails where fewer are at hand."""
    part = [by] if by else []
    w = Window.partitionBy(*part).orderBy(order_key(seed, F.col(key)), key)
    first = keys.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)  # the limit is pushed below the shuffle
    there = keys.groupBy(*part).agg(F.count("*").alias("there"))
    x = first.join(there, by) if by else first.withColumn("there", F.lit(there.first()[0]))
    enough = F.when(F.col("there") < n, F.raise_error(F.lit(f"fewer than {n} prompts")).cast("string")).when(F.col("rank") <= int(n * ratio), "train").otherwise("test")
    return x.withColumn("side", enough).drop("rank", "there")


def sample(df: DataFrame, n: int, seed: int = 42, key: str = "prompt") -> DataFrame:
    """n rows in the order of their hashes; all where there are no more."""
    return df.orderBy(order_key(seed, F.col(key)), key).limit(n)


def rows_with(df: DataFrame, keys: DataFrame, prompt: str = "Prompts", key: str = "prompt") -> DataFrame:
    return df.join(keys.select(F.col(key).alias("__key")).distinct(), strip(F.col(prompt)) == F.col("__key"), "left_semi")


def assert_disjoint(a: DataFrame, b: DataFrame, key: str = "prompt") -> None:
    if not a.select(key).intersect(b.select(key)).isEmpty():
        raise ValueError("the two sides share prompts")


def without_leaks(test: DataFrame, train: DataFrame, key: str = "question") -> DataFrame:
    """Test rows whose key no training row has; by hashes of the texts first, then by the texts."""
    t = train.select(F.xxhash64(key).alias("__h"), F.col(key).alias("__k")).distinct()
    return test.join(t, (F.xxhash64(key) == F.col("__h")) & (F.col(key) == F.col("__k")), "left_anti")


def _validation(groups: DataFrame, ratio: float, seed: int, order: str) -> DataFrame:
    """(group) of the validation head: max(1, the share rounded half to even) of the shuffled groups, none of a single one."""
    if order == "python":  # the generator's own order needs all keys in one place, so there must be few
        keys = sorted(r[0] for r in groups.limit(PYTHON_KEYS + 1).collect())
        if len(keys) > PYTHON_KEYS:
            raise ValueError(f'more than {PYTHON_KEYS} groups: order="python" shuffles them in one place, order="md5" does not')
        random.Random(seed).shuffle(keys)
        return groups.sparkSession.createDataFrame([(k,) for k in keys[: max(1, round(len(keys) * ratio)) if len(keys) > 1 else 0]], "group string")
    n = groups.count()
    n_val = max(1, round(n * ratio)) if n > 1 else 0
    return hash_head(groups, "group", n_val, seed)


def split_by_prompt(records: DataFrame, ratio: float = 0.1, seed: int = 42, retain_only: bool = True, group_by: str = "user_prompt", order: str = "md5") -> DataFrame:
    """records with side, train or val, no prompt on both.

    retain_only: validation rows are retain rows alone, and retain rows that share a prompt with a forget row train.
    Otherwise, and with group_by="source_row", both modes of one source row stay together.
    """
    prompt = strip(F.coalesce("user_prompt", F.lit("")))
    source = F.when(F.col("sample_id").contains("_m"), F.regexp_replace("sample_id", r"(?U)_m\d+_", "_")).when(prompt != "", prompt).otherwise(F.col("sample_id"))
    x = records.withColumn("group", prompt if retain_only and group_by == "user_prompt" else source)
    if ratio <= 0:
        return x.drop("group").withColumn("side", F.lit("train"))
    candidates = x
    if retain_only:
        forced = x.where("split_type = 'forget'").select(F.col("group").alias("f")).where("f <> ''").distinct()
        candidates = x.where("split_type <> 'forget'").join(forced, F.col("group") == F.col("f"), "left_anti")
    val = _validation(candidates.select("group").distinct(), ratio, seed, order).select(F.col("group").alias("v")).withColumn("is_val", F.lit(True))
    y = x.join(val, F.col("group") == F.col("v"), "left")
    can = (F.col("split_type") != "forget") if retain_only else F.lit(True)
    return y.withColumn("side", F.when(F.col("is_val") & can, "val").otherwise("train")).drop("group", "v", "is_val")


def split_rows(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """df with side: single rows, whatever their prompts, by the share rounded half to even."""
    n = df.count()
    head = hash_head(df.select(F.col(key).alias("__key")), "__key", round(n * ratio), seed).withColumn("__in", F.lit(True))
    return df.join(head, F.col(key) == F.col("__key"), "left").withColumn("side", F.when(F.col("__in"), "val").otherwise("train")).drop("__key", "__in")


def balanced_partition(df: DataFrame, key: str, label: str, exemplars: int, wild_ratio: float, seed: int = 42) -> DataFrame:
    """df with part: exemplar for exemplars // 2 rows of each label, then wild for int(wild_ratio * rest) rows, test for the others."""
    w = Window.partitionBy(label).orderBy(order_key(seed, F.col(key)), key)
    first = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= exemplars // 2).select(F.col(key).alias("__e"), F.lit(True).alias("__exemplar"))
    rest = df.select(F.col(key).alias("__key")).join(first, F.col("__key") == F.col("__e"), "left_anti")
    wild = hash_head(rest, "__key", int(wild_ratio * rest.count()), seed + 1).withColumn("__wild", F.lit(True))
    x = df.join(first, F.col(key) == F.col("__e"), "left").join(wild, F.col(key) == F.col("__key"), "left")
    return x.withColumn("part", F.when(F.col("__exemplar"), "exemplar").when(F.col("__wild"), "wild").otherwise("test")).drop("__e", "__exemplar", "__key", "__wild")


def split_metadata(df: DataFrame, source: str = "_source_file", side: str = "side") -> DataFrame:
    return df.groupBy(source, side).agg(F.count("*").alias("n"))
