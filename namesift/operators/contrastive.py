"""Contrastive records: valid against hallucinated answers, with spans of the names and shuffled variations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

from namesift.functions import lists, prompts
from namesift.functions.finding import lengths_before
from namesift.functions.text import strip
from namesift.operators import records as rec
from namesift.operators import split


@F.pandas_udf(ArrayType(IntegerType()))
def _starts(names: pd.Series) -> pd.Series:
    """Where each name begins when they are joined by two signs: one running sum a row."""
    return names.map(lambda x: None if x is None else lengths_before([len(n) if n is not None else 0 for n in x], 2))


@F.pandas_udf(ArrayType(BooleanType()))
def _among(names: pd.Series, others: pd.Series) -> pd.Series:
    """Whether each name is one of the others, in any letter case: by a set for each row."""

    def one(x, y):
        known = {n.lower() for n in y if n is not None} if y is not None else set()
        return None if x is None else [n is not None and n.lower() in known for n in x]

    return pd.Series([one(x, y) for x, y in zip(names, others, strict=True)])


def locate(names: Column, hallucinated: Column) -> Column:
    """For each name its place and character span in the names joined by comma and blank.

    A name is hallucinated if it is one of these in any letter case; a set for each row tells.
    """
    def one(z: Column, i: Column) -> Column:
        p = z["name"]
        return F.struct(
            p.alias("package_name"), z["bad"].alias("is_hallucinated"), i.alias("position_idx"), (i == 0).alias("is_first"),
            F.when(i > 0, ", ").otherwise("").alias("preceding_separator"), z["start"].alias("char_start"), (z["start"] + F.length(p)).alias("char_end"),
        )

    return F.transform(F.arrays_zip(names.alias("name"), _starts(names).alias("start"), _among(names, hallucinated).alias("bad")), one)


#: Columns that a record's contrastive rows take over where it has them.
CARRIED = ("part",)


def originals(base: DataFrame) -> DataFrame:
    """One contrastive record for each forget record with hallucinated names."""
    said = F.coalesce(F.nullif(F.col("rejected"), F.lit("")), F.nullif(F.col("completion"), F.lit("")))
    named = F.filter(F.transform(F.split(said, ","), strip), lambda x: x != "")
    names = F.when(F.size(named) > 0, named).otherwise(F.concat("valid_packages", "hallucinated_packages"))
    return base.withColumn("__names", names).select(
        "sample_id", F.col("sample_id").alias("base_sample_id"), F.lit(False).alias("is_shuffled_variation"), F.lit(0).alias("variation_idx"),
        prompts.question(F.col("system_prompt"), F.col("user_prompt")).alias("question"), lists.format_packages(F.col("valid_packages")).alias("answer_matching_behavior"),
        F.array_join("hallucinated_packages", ", ").alias("answer_not_matching_behavior"), F.array_join("__names", ", ").alias("completion"),
        locate(F.col("__names"), F.col("hallucinated_packages")).alias("packages_info"), "valid_packages", "hallucinated_packages", "system_prompt", "user_prompt", "split_type", "mode",
        *(c for c in CARRIED if c in base.columns),
    )


def shuffled(items: Column, seed: int, key: Column, attempt: Column) -> Column:
    """An order of the items by the md5 of seed, key, attempt, place and item."""
    tagged = F.transform(items, lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key, attempt.cast("string"), i.cast("string"), x)).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda s: s["x"])


def _chosen(k: Column) -> Column:
    """Places of an order of k names that its rank tells; with k beyond some size fewer, so that ranks stay longs."""
    return F.when(k <= 26, F.least(k, F.lit(12))).when(k <= 1000, 6).otherwise(3)


def _orders(k: Column) -> Column:
    """Ranks there are: ways to fill the chosen places with k names."""
    return F.aggregate(F.sequence(F.lit(0), _chosen(k) - 1), F.lit(1).cast("long"), lambda n, i: n * (k - i))


def unranked(items: Column, rank: Column) -> Column:
    """The order of the items with a rank: digit by digit (base k, k - 1, ...) it takes one of the items left to the next place; those left at the end follow."""
    start = F.struct(items.alias("left"), F.filter(items, lambda x: F.lit(False)).alias("out"), rank.alias("rank"))

    def step(s: Column, i: Column) -> Column:
        left = s["left"]
        at = (s["rank"] % F.size(left)).cast("int")
        rest = F.concat(F.slice(left, F.lit(1), at), F.slice(left, at + 2, F.size(left)))
        return F.struct(rest.alias("left"), F.concat(s["out"], F.array(F.get(left, at))).alias("out"), F.call_function("div", s["rank"], F.size(left)).alias("rank"))

    return F.aggregate(F.sequence(F.lit(1), _chosen(F.size(items))), start, step, lambda s: F.concat(s["out"], s["left"]))


def variations(original: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Up to n distinct orders of each record's names, none as the original.

    Names are shuffled once by their hashes; of that order others follow by their ranks, a fixed step apart from a
    hashed start, which differ by construction. Equal names make some of them equal, so 5 n ranks are tried; where no
    more orders are there, all are. Valid and hallucinated names are shuffled by the variation's number. All of it lies
    in the row.
    """
    key = F.col("base_sample_id")
    names = F.transform("packages_info", lambda p: p["package_name"])
    x = original.withColumn("__names", names).where(F.size("__names") > 1)
    x = x.withColumns({"__first": shuffled(F.col("__names"), seed, key, F.lit(0)), "__of": _orders(F.size("__names"))})
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|rank|"), key)), 1, 15), 16, 10).cast("long")
    tries = 5 * n
    x = x.withColumns({"__step": F.greatest(F.lit(1), F.expr(f"__of div {tries}")), "__start": start % F.col("__of")})
    # generators, so that the orders are made once and not anew in each expression over them
    ranks = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda j: (F.col("__start") + j * F.col("__step")) % F.col("__of"))
    x = x.withColumn("__ranks", F.explode(F.array(F.array_distinct(ranks))))
    x = x.withColumn("__orders", F.explode(F.array(F.transform("__ranks", lambda r: unranked(F.col("__first"), r)))))
    others = F.filter(F.array_distinct("__orders"), lambda o: F.array_join(o, ", ") != F.col("completion"))
    x = x.withColumn("__chosen", F.explode(F.array(F.slice(others, 1, n))))
    y = x.select("*", F.posexplode("__chosen").alias("__i", "__new")).withColumn("variation_idx", F.col("__i") + 1)
    y = y.withColumns({"__v": shuffled(F.col("valid_packages"), seed, key, F.col("variation_idx")), "__h": shuffled(F.col("hallucinated_packages"), seed, key, F.col("variation_idx"))})
    return y.select(
        F.concat("base_sample_id", F.lit("_shuf"), F.col("variation_idx").cast("string")).alias("sample_id"), "base_sample_id", F.lit(True).alias("is_shuffled_variation"), "variation_idx", "question",
        lists.format_packages(F.col("__v")).alias("answer_matching_behavior"), F.array_join("__h", ", ").alias("answer_not_matching_behavior"), F.array_join("__new", ", ").alias("completion"),
        locate(F.col("__new"), F.col("__h")).alias("packages_info"), F.col("__v").alias("valid_packages"), F.col("__h").alias("hallucinated_packages"), "system_prompt", "user_prompt", "split_type", "mode",
        *(c for c in CARRIED if c in original.columns),
    )


def contrastive(train: DataFrame, test: DataFrame | None = None, n: int = 3, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Contrastive records with part (train, val, test) and order, by a hash of seed and id; test questions that train has are dropped. Fails without hallucinated names."""
    usable = lambda d: rec.usable_prompts(d).where(F.size("hallucinated_packages") > 0)
    base = usable(train)
    if base.isEmpty():
        raise ValueError("no records with hallucinated names")
    parts = split.split_by_prompt(base, ratio, seed, retain_only=False).withColumnRenamed("side", "part")
    if test is not None:
        asked = lambda d: d.withColumn("question", prompts.question(F.col("system_prompt"), F.col("user_prompt")))
        parts = parts.unionByName(split.without_leaks(asked(usable(test)), asked(base)).drop("question").withColumn("part", F.lit("test")), allowMissingColumns=True)
    own = originals(parts)
    return own.unionByName(variations(own, n, seed)).withColumn("order", split.order_key(seed, F.col("sample_id")))
