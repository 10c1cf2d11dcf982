"""Strings: trimming, null words, the variants of package-name normalisation.

Patterns are Unicode-aware ((?U)) and let a dot cross every line end but a line feed ((?d)), as the data was made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space, with the four separators \x1c to \x1f.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same signs, one after another.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NULL_WORDS = ("nan", "none", "null")


def strip(x: Column) -> Column:
    """White space off both ends."""
    return F.btrim(x, F.lit(SPACES))


def without_null_words(x: Column) -> Column:
    """Stripped text; null, and the words that stand for null, become empty."""
    s = F.coalesce(strip(x), F.lit(""))
    return F.when(F.lower(s).isin(*NULL_WORDS), "").otherwise(s)


def sanitize(df: DataFrame) -> DataFrame:
    """Every string column without NUL and with bare line feeds."""
    clean = lambda c: F.replace(F.replace(F.col(f"`{c}`"), F.lit("\x00"), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return df.select(*(clean(f.name).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in df.schema))


def _line_feeds(x: Column) -> Column:
    """A line feed inside a name becomes a space, any other goes."""
    return F.regexp_replace(F.regexp_replace(x, r"(?d)(?<=.)\n(?=.)", " "), r"\n", "")


def _hyphens(x: Column) -> Column:
    return F.regexp_replace(x, "[-_.]+", "-")


def normalize_python_package(x: Column) -> Column:
    """The canonical name: list numbers go wherever they are, separators become one hyphen, ends are trimmed, lower case."""
    return F.lower(F.btrim(_hyphens(_line_feeds(F.regexp_replace(x, r"(?U)\d+\.\s*", ""))), F.lit(" `.-_")))


def normalize_package(x: Column) -> Column:
    """The name as matched in texts: only a leading list number goes, quotes are trimmed too; null is empty."""
    y = _hyphens(_line_feeds(F.regexp_replace(x, r"(?U)^\d+[.)]\s*", "")))
    return F.coalesce(F.lower(F.btrim(y, F.lit(" `.-_\"'"))), F.lit(""))


def normalize_pip(x: Column) -> Column:
    return F.lower(F.btrim(_hyphens(F.regexp_replace(x, "[()'\"]", "")), F.lit(' "`.-')))


def normalize_python_legacy(x: Column) -> Column:
    """One digit, a dot and a space go; an underscore at an end stays a hyphen's business."""
    return F.lower(F.btrim(_hyphens(_line_feeds(F.regexp_replace(x, r"(?U)\d\. ", ""))), F.lit(" `.-")))


def normalize_javascript(x: Column) -> Column:
    return F.replace(x, F.lit("`"), F.lit(""))


def after_reasoning(x: Column) -> Column:
    """What follows the first closing think tag, stripped; the text itself without one."""
    at = F.instr(x, "</think>")
    return F.when(at > 0, strip(F.substring(x, at + 8, F.length(x)))).otherwise(x)


def register(spark) -> None:
    """The normalisations as SQL functions of the session."""
    body = {
        "normalize_python_package": r"lower(btrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?U)\\d+\\.\\s*', ''), '(?d)(?<=.)\\n(?=.)', ' '), '\\n', ''), '[-_.]+', '-'), ' `.-_'))",
        "normalize_pip": r"""lower(btrim(regexp_replace(regexp_replace(x, '[()\'"]', ''), '[-_.]+', '-'), ' "`.-'))""",
        "normalize_javascript": "replace(x, '`', '')",
    }
    for name, sql in body.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {sql}")
