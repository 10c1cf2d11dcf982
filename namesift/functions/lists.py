"""Lists of names as text, and back."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from namesift.functions.text import strip

_NO_LIST = ("", "[]", "none", "nan")


def empty() -> Column:
    return F.array().cast("array<string>")


def _clean(a: Column) -> Column:
    return F.filter(F.transform(a, strip), lambda x: x != "")


@F.pandas_udf(ArrayType(StringType()))
def _literal(values: pd.Series) -> pd.Series:
    """What only a literal parser reads: escapes, None items, tuples; null where it is no literal."""

    def one(v):
        if v is None:
            return None
        try:
            x = ast.literal_eval(v.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None
        return [str(i) for i in x] if isinstance(x, (list, tuple, set)) else [str(x)]

    return values.map(one)


def _plain(v: Column) -> Column:
    """Whether v is a bracketed list of plainly quoted items. Items become one sign first: a repeated group would need a stack as deep as the list is long."""
    signs = F.regexp_replace(F.regexp_replace(v, r"\"[^\"\\]*\"|'[^'\"\\]*'", "\x01"), r"\s+", "")
    return ~F.contains(v, F.lit("\x01")) & ((signs == "[]") | (F.replace(signs, F.lit("\x01,"), F.lit("")) == "[\x01]"))


def parse_package_list(x: Column, exact: bool = False) -> Column:
    """The stripped, non-empty items of a list as printed, of JSON, or of text divided by commas; none for null and its words.

    Lists whose items are plainly quoted are read by the JSON reader. exact=True sends the rest through a literal
    parser in Python first (escapes, None, numbers, tuples); without it they are divided at commas.
    """
    v = strip(x)
    plain = _plain(v)
    read = F.from_json(v, "array<string>", {"allowSingleQuotes": "true"})
    inner = F.btrim(v, F.lit("[]'\""))
    divided = F.filter(F.transform(F.split(inner, ","), lambda i: F.btrim(strip(i), F.lit("'\""))), lambda i: i != "")
    rest = F.coalesce(_clean(_literal(F.when(~plain, v))), divided) if exact else divided
    return F.when(v.isNull() | F.lower(v).isin(*_NO_LIST), empty()).when(plain, _clean(read)).otherwise(rest)


def list_size(x: Column) -> Column:
    """Items of a list as printed; 0 for what is no list."""
    v = strip(x)
    return F.coalesce(F.size(F.from_json(F.when(v.rlike(r"(?s)^\[.*\]$"), v), "array<string>", {"allowSingleQuotes": "true"})), F.lit(0))


def format_packages(a: Column, fallback: str = "None") -> Column:
    """Non-empty items joined by comma and blank."""
    some = F.filter(a, lambda x: x != "")
    return F.when(F.size(some) > 0, F.array_join(some, ", ")).otherwise(fallback)


def ordered_distinct(a: Column) -> Column:
    """The first of equal items, in order, without empty ones."""
    return F.filter(F.array_distinct(a), lambda x: x != "")


def distinct_longer(a: Column, least: int = 3) -> Column:
    """Distinct items of at least `least` characters, sorted (the order of sets means nothing)."""
    return F.array_sort(F.filter(F.array_distinct(a), lambda x: F.length(x) >= least))
