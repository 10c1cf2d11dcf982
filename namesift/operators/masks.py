"""Token masks: where names lie in answers, three-way masks, padded batches, spans of names in tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from namesift.boundary import Tokenizer
from namesift.functions import lists, prompts
from namesift.functions.finding import NameFinder, Positions, overlapping
from namesift.functions.text import normalize_package
from namesift.operators.align import row_numbers

SPANS = ArrayType(StructType([StructField("s", IntegerType()), StructField("e", IntegerType())]))
IGNORE = -100


@F.arrow_udf(SPANS)
def _spans(texts: pa.Array, names: pa.Array) -> pa.Array:
    """One automaton for the names of all rows of a batch; each text is read once, places lie in flat arrays."""
    keys = [x.as_py() or [] for x in names]
    finder, flat, ends = NameFinder({n for own in keys for n in own}), ([], []), [0]
    for t, own in zip(texts, keys, strict=True):
        for s, e in finder.spans(t.as_py() or "", own):
            flat[0].append(s)
            flat[1].append(e)
        ends.append(len(flat[0]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in flat], ["s", "e"]))


def find_names(text: Column, names: Column) -> Column:
    """Spans (code points, end exclusive) of the names in a text, in the order they are taken."""
    keys = F.filter(F.transform(F.coalesce(names, lists.empty()), normalize_package), lambda x: x != "")
    return _spans(text, keys)


def overlaps(s: Column, e: Column, spans: Column) -> Column:
    return F.exists(spans, lambda p: ~((e <= p["s"]) | (p["e"] <= s)))


@F.pandas_udf(ArrayType(IntegerType()))
def _mask(s: pd.Series, e: pd.Series, hs: pd.Series, he: pd.Series, vs: pd.Series, ve: pd.Series) -> pd.Series:
    out = []
    for row in zip(s, e, hs, he, vs, ve, strict=True):
        if row[0] is None:
            out.append(None)
            continue
        starts, ends, *spans = (np.asarray([] if x is None else x, np.int64) for x in row)
        out.append(np.where(overlapping(starts, ends, spans[0], spans[1]), 2, overlapping(starts, ends, spans[2], spans[3])).astype(np.int32))
    return pd.Series(out)


def response_mask(tokens: Column, hallucinated: Column, valid: Column) -> Column:
    """2 for a token over a hallucinated name, else 1 over a valid one, else 0; 0 for tokens without width.

    The spans of one kind do not overlap each other, so tokens and spans are sorted and met once. All three must be
    columns that are there already.
    """
    of = lambda c, f: F.transform(c, lambda t: t[f])
    return _mask(of(tokens, "s"), of(tokens, "e"), of(hallucinated, "s"), of(hallucinated, "e"), of(valid, "s"), of(valid, "e"))


def tri_mask(records: DataFrame, tokenizer: Tokenizer, family: str = "llama3", max_length: int = 2048, single_objective_forget: bool = True, template: str = "T1") -> DataFrame:
    """(id, mode, input_ids, attention_mask, labels, tri_mask, template, truncated) of records.

    Prompt tokens are 0, the closing end mark is 1. Retain records have no hallucinated names; forget records have no
    valid ones either with single_objective_forget. An over-long answer is cut, one place left for the end mark; where
    the prompt leaves no room the record goes.
    """
    ask = prompts.chat(prompts.messages(F.col("system_prompt"), F.col("user_prompt")), family, True)
    forget = F.col("split_type") == "forget"
    hall = F.when(forget, F.col("hallucinated_packages")).otherwise(lists.empty())
    valid = F.when(forget & F.lit(single_objective_forget), lists.empty()).otherwise(F.col("valid_packages"))
    x = records.select(F.col("sample_id").alias("id"), F.when(forget, "forget").otherwise("retain").alias("mode"), tokenizer.tokens(ask).alias("p"), tokenizer.tokens(F.col("completion")).alias("r"), find_names(F.col("completion"), hall).alias("h"), find_names(F.col("completion"), valid).alias("v"))
    room = F.lit(max_length - 1) - F.size("p")
    x = x.withColumns({"room": room, "truncated": F.size("r") > room}).where("room > 0").withColumn("r", F.slice("r", F.lit(1), F.col("room")))
    zeros = F.array_repeat(F.lit(0), F.size("p"))
    x = x.select("id", "mode", F.concat(F.transform("p", lambda t: t["id"]), F.transform("r", lambda t: t["id"]), F.array(F.lit(tokenizer.eos))).alias("input_ids"), F.concat(zeros, response_mask(F.col("r"), F.col("h"), F.col("v")), F.array(F.lit(1))).alias("tri_mask"), "truncated")
    labels = F.transform(F.arrays_zip("input_ids", "tri_mask"), lambda z: F.when(z["tri_mask"] == 0, IGNORE).otherwise(z["input_ids"]))
    return x.select("id", "mode", "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"), labels.alias("labels"), "tri_mask", F.lit(template).alias("template"), "truncated")


def checked(df: DataFrame) -> DataFrame:
    """df; reading it fails where the four arrays differ in length or a mask is not 0, 1 or 2."""
    uneven = (F.size("input_ids") != F.size("attention_mask")) | (F.size("input_ids") != F.size("labels")) | (F.size("input_ids") != F.size("tri_mask"))
    bad = uneven | F.exists("tri_mask", lambda m: ~m.isin(0, 1, 2))
    return df.withColumn("tri_mask", F.when(bad, F.raise_error(F.lit("uneven arrays or unknown mask")).cast("array<int>")).otherwise(F.col("tri_mask")))


def mask_counts(df: DataFrame, by: str | None = None) -> DataFrame:
    n = lambda v: F.sum(F.size(F.filter("tri_mask", lambda m: m == v))).cast("long")
    return df.groupBy(*([by] if by else [])).agg(n(0).alias("ignored"), n(1).alias("retain"), n(2).alias("forget"))


def padded(df: DataFrame, batch_size: int, pad: int = 0, multiple: int = 8, key: str = "row_id") -> DataFrame:
    """df with batch_id and arrays padded on the right to the batch's longest, rounded up: ids by `pad`, labels by -100, masks by 0. multiple=1 does not round."""
    x = row_numbers(df, key, "batch_id").withColumn("batch_id", (F.col("batch_id") / batch_size).cast("long"))
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch_id"))
    x = x.withColumn("__to", (F.ceil(longest / multiple) * multiple).cast("int"))
    fill = {"input_ids": pad, "attention_mask": 0, "labels": IGNORE, "tri_mask": 0}
    return x.withColumns({c: F.concat(c, F.array_repeat(F.lit(v), F.col("__to") - F.size(c))) for c, v in fill.items() if c in df.columns}).drop("__to")


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _positions(s: pd.Series, e: pd.Series, names_s: pd.Series, names_e: pd.Series) -> pd.Series:
    out = []
    for starts, ends, a, b in zip(s, e, names_s, names_e, strict=True):
        if starts is None or a is None:
            out.append(None)
            continue
        tokens, row = Positions(np.asarray(starts, np.int64), np.asarray(ends, np.int64)), []
        for x, y in zip(a, b, strict=True):
            own = tokens.within(int(x), int(y))
            near = None if own else tokens.nearest(int(x))
            row.append(own or ([] if near is None else [near]))
        out.append(row)
    return pd.Series(out)


def name_token_spans(packages_info: Column, tokens: Column, prompt_size: Column) -> Column:
    """For each name its token positions, the first of them, and the token before it (the prompt's last one for the first name).

    A name that no token overlaps takes the token that begins nearest to it, the first of equals. tokens must be a
    column that is there already: lambda functions cannot hold a tokenizer's call. Tokens are sorted once a row, each
    name then finds its own among them.
    """
    of = lambda c, f: F.transform(c, lambda t: t[f])
    found = _positions(of(tokens, "s"), of(tokens, "e"), of(packages_info, "char_start"), of(packages_info, "char_end"))

    def one(z: Column) -> Column:
        p, at = z["p"], F.transform(z["at"], lambda i: i + prompt_size)
        first = F.get(at, F.lit(0))
        return F.struct(p["package_name"].alias("package_name"), p["is_hallucinated"].alias("is_hallucinated"), at.alias("positions"), first.alias("package_start"), F.when(p["is_first"], prompt_size - 1).otherwise(first - 1).alias("boundary"))

    return F.transform(F.arrays_zip(packages_info.alias("p"), found.alias("at")), one)
