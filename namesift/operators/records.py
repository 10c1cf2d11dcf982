"""Result rows as forget and retain records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from namesift.functions import lists, prompts
from namesift.functions.text import strip, without_null_words

FIELDS = ("sample_id", "split_type", "mode", "system_prompt", "user_prompt", "completion", "chosen", "rejected", "valid_packages", "hallucinated_packages")


def _list(df: DataFrame, *names: str) -> Column:
    """The first of these columns that is there, as an array."""
    for n in names:
        if n in df.columns:
            c = F.col(n)
            if isinstance(df.schema[n].dataType, ArrayType):
                return F.filter(F.transform(F.coalesce(c, lists.empty()), lambda x: strip(x)), lambda x: x != "")
            return lists.parse_package_list(c)
    return lists.empty()


def _text(df: DataFrame, name: str) -> Column:
    return without_null_words(F.col(name).cast("string")) if name in df.columns else F.lit("")


def has_hallucination(df: DataFrame) -> Column:
    """Whether any of a row's three lists of hallucinated names has items."""
    return (F.size(_list(df, "hallucinated_1", "hallucination_1")) > 0) | (F.size(_list(df, "hallucinated_2", "hallucination_2")) > 0) | (F.size(_list(df, "pip_hallucinated")) > 0)


def unpivot_modes(df: DataFrame) -> DataFrame:
    """(row_id, _source_file, mode, content, valid, hall, test): up to two rows for each result row, without those that have no content."""
    prompt = F.coalesce(F.nullif(_text(df, "Prompts"), F.lit("")), _text(df, "Questions"))
    source = F.coalesce(F.col("_source_file"), F.concat(F.lit("row_"), F.col("row_id").cast("string"))) if "_source_file" in df.columns else F.concat(F.lit("row_"), F.col("row_id").cast("string"))
    side = lambda k, content: F.struct(
        F.lit(k).alias("mode"), content.alias("content"), _list(df, f"valid_{k}", f"valid{k}").alias("valid"),
        _list(df, f"hallucinated_{k}", f"hallucination_{k}").alias("hall"), _list(df, f"Test_{k}").alias("test"),
    )
    x = df.select("row_id", source.alias("_source_file"), F.inline(F.array(side(1, _text(df, "Answers")), side(2, prompt))))
    return x.where("content <> ''")


def extract_records(df: DataFrame, modes: tuple[int, ...] = (1, 2), mode_prompts: dict[int, tuple[str, str]] | None = None, split_type: str = "all", target: str = "all_generated", fallback: str = "None") -> DataFrame:
    """Records (FIELDS and row_id) of result rows with row_id.

    Rows with hallucinated names become forget records; those without, but with valid names, retain records; others
    none. target: all_generated (the extracted names, else valid then hallucinated ones) or hallucinated_only.
    """
    say = mode_prompts or {k: (prompts.SYSTEM[k], prompts.PREFIX[k]) for k in (1, 2)}
    pick = lambda i: F.coalesce(*(F.when(F.col("mode") == k, F.lit(v[i])) for k, v in say.items()), F.lit(""))
    x = unpivot_modes(df).where(F.col("mode").isin(*modes))
    forget = F.size("hall") > 0
    wanted = F.col("hall") if target == "hallucinated_only" else F.when(F.size("test") > 0, F.col("test")).otherwise(F.concat("valid", "hall"))
    valid_text, forget_text = lists.format_packages(F.col("valid"), fallback), lists.format_packages(wanted, fallback)
    x = x.where(forget | (F.size("valid") > 0)).select(
        "row_id", F.concat("_source_file", F.lit("_m"), F.col("mode").cast("string"), F.lit("_idx"), F.col("row_id").cast("string")).alias("sample_id"),
        F.when(forget, "forget").otherwise("retain").alias("split_type"), "mode", pick(0).alias("system_prompt"),
        strip(F.concat(pick(1), F.lit(" "), F.col("content"))).alias("user_prompt"),
        F.when(forget, forget_text).otherwise(valid_text).alias("completion"), valid_text.alias("chosen"),
        F.when(forget, forget_text).otherwise("").alias("rejected"), F.col("valid").alias("valid_packages"), F.col("hall").alias("hallucinated_packages"),
    )
    return x if split_type == "all" else x.where(F.col("split_type") == split_type)


def preference_pairs(records: DataFrame, family: str) -> DataFrame:
    """(sample_id, prompt, chosen, rejected, split_type, mode) with the prompt in a chat template that asks for an answer."""
    return records.select("sample_id", prompts.chat(prompts.messages(F.col("system_prompt"), F.col("user_prompt")), family, True).alias("prompt"), "chosen", "rejected", "split_type", "mode")


def pointwise(records: DataFrame, tokenizer, family: str, max_length: int = 2048) -> DataFrame:
    """Tokenised records: labels are -100 on the prompt; over-long ones are cut off."""
    ask = prompts.messages(F.col("system_prompt"), F.col("user_prompt"))
    whole = F.concat(ask, F.array(F.struct(F.lit("assistant").alias("role"), F.col("completion").alias("content"))))
    ids = lambda c: F.transform(tokenizer.tokens(c), lambda t: t["id"])
    x = records.withColumn("p", F.size(tokenizer.tokens(prompts.chat(ask, family, True)))).withColumn("input_ids", ids(prompts.chat(whole, family)))
    x = x.withColumn("labels", F.concat(F.array_repeat(F.lit(-100), F.col("p")), F.slice("input_ids", F.col("p") + 1, F.greatest(F.size("input_ids") - F.col("p"), F.lit(0)))))
    cut = lambda c: F.slice(c, 1, max_length)
    x = x.withColumns({"input_ids": cut("input_ids"), "labels": cut("labels")})
    return x.select("sample_id", "split_type", "mode", "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"), "labels")


def check_labels(df: DataFrame, vocabulary: int, labels: str = "labels") -> DataFrame:
    """df; reading it fails where a label other than -100 is outside the vocabulary."""
    bad = F.exists(labels, lambda x: (x != -100) & ((x < 0) | (x >= vocabulary)))
    return df.withColumn(labels, F.when(bad, F.raise_error(F.lit("label outside the vocabulary")).cast(df.schema[labels].dataType)).otherwise(F.col(labels)))


def usable_prompts(df: DataFrame, prompt: str = "user_prompt") -> DataFrame:
    p = F.col(prompt)
    return df.where(p.isNotNull() & ~p.isin("nan", "None", "") & ~p.endswith(": nan"))


def first_rows(df: DataFrame, n: int, key: str = "row_id") -> DataFrame:
    """The first n rows by their numbers."""
    return df.orderBy(key).limit(n)
