"""The driver's tables in the shapes of this engine's inputs; each helper has a SQL twin for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, w, t): documents with a word as answers of the same shapes, made of all their words, four by four.

    The last group goes on with the text's first words; w has four words at least in the same way.
    """
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    # generators, so that w and t are made once for each document and not again in each expression over them
    x = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.array(w)).alias("w")).where(F.size("w") > 0)
    # never a remainder by 0: a filter's place in the plan is not fixed, and texts without words may be met before it
    at = lambda i: F.get("w", F.pmod(i, F.greatest(F.size("w"), F.lit(1))))
    groups = F.sequence(F.lit(0), F.expr("(size(w) - 1) div 4").cast("int"))
    t = F.array_join(F.transform(groups, lambda g: _shaped([at(4 * g + i) for i in range(4)])), "\n")
    long = F.when(F.size("w") >= 4, F.col("w")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(3)), at))
    return x.select("doc_id", "source", "w", F.explode(F.array(t)).alias("t")).select("doc_id", "source", long.alias("w"), "t")


def _shaped(p: list[Column]) -> Column:
    """Four words in the shape of the document's id."""
    c = lambda *parts: F.concat(*(F.lit(a) if isinstance(a, str) else a for a in parts))
    shapes = [
        c("1. `", p[0], "`\n2) `", p[1], "`\n3. ", p[2], " from ", p[3]),
        c("pip install ", p[0], " ", p[1], "\nthen\npip  install -U ", p[2], "\npip install ", p[3], "==1.0"),
        c(p[0], ", ", p[1], "\nNote: ", p[2], ", ", p[3]),
        c("Run:\n```python\nimport ", p[0], ".", p[1], "\nfrom ", p[2], " import ", p[3], "\n```\n", p[0], ", ", p[3]),
        c("<think>", p[0], " ", p[1], "</think>  ", p[2], ", ", p[3], " "),
        c("* ", p[0], "\r\n* ", p[1], "\r\n* ", p[2], "_path\r\n* get", p[3]),
    ]
    t = F.lit("")
    for i, s in enumerate(shapes):
        t = F.when(F.col("doc_id") % 6 == i, s).otherwise(t)
    return t


_AT = [f"w0[(4 * g + {i}) % len(w0) + 1]" for i in range(4)]
DOMAIN = rf"""
SELECT doc_id, source, CASE WHEN len(w0) >= 4 THEN w0 ELSE list_transform(range(0, 4), lambda i: w0[i % len(w0) + 1]) END AS w,
array_to_string(list_transform(range(0, (len(w0) - 1) // 4 + 1), lambda g: CASE doc_id % 6
  WHEN 0 THEN '1. `' || {_AT[0]} || '`' || chr(10) || '2) `' || {_AT[1]} || '`' || chr(10) || '3. ' || {_AT[2]} || ' from ' || {_AT[3]}
  WHEN 1 THEN 'pip install ' || {_AT[0]} || ' ' || {_AT[1]} || chr(10) || 'then' || chr(10) || 'pip  install -U ' || {_AT[2]} || chr(10) || 'pip install ' || {_AT[3]} || '==1.0'
  WHEN 2 THEN {_AT[0]} || ', ' || {_AT[1]} || chr(10) || 'Note: ' || {_AT[2]} || ', ' || {_AT[3]}
  WHEN 3 THEN 'Run:' || chr(10) || '```python' || chr(10) || 'import ' || {_AT[0]} || '.' || {_AT[1]} || chr(10) || 'from ' || {_AT[2]} || ' import ' || {_AT[3]} || chr(10) || '```' || chr(10) || {_AT[0]} || ', ' || {_AT[3]}
  WHEN 4 THEN '<think>' || {_AT[0]} || ' ' || {_AT[1]} || '</think>  ' || {_AT[2]} || ', ' || {_AT[3]} || ' '
  ELSE '* ' || {_AT[0]} || chr(13) || chr(10) || '* ' || {_AT[1]} || chr(13) || chr(10) || '* ' || {_AT[2]} || '_path' || chr(13) || chr(10) || '* get' || {_AT[3]} END), chr(10)) AS t
FROM (SELECT doc_id, source, regexp_extract_all(text, '[A-Za-z]{{3,}}') AS w0 FROM documents) WHERE len(w0) > 0
"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, name): the parts of each text between commas and line feeds, normalised, that are names."""
    from namesift.functions.text import normalize_python_package

    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split("text", "[,\n]")).alias("part"))
    return d.select("doc_id", "source", normalize_python_package(F.col("part")).alias("name")).where((F.length("name") > 2) & ~F.col("name").contains(" "))


NAME = "lower(trim(regexp_replace(regexp_replace({x}, '\\d+\\.\\s*', '', 'g'), '[-_.]+', '-', 'g'), ' `.-_'))"
MENTIONS = f"SELECT * FROM (SELECT doc_id, source, {NAME.format(x='part')} AS name FROM (SELECT doc_id, source, unnest(regexp_split_to_array(text, '[,\\n]')) AS part FROM documents)) WHERE length(name) > 2 AND NOT contains(name, ' ')"


def good_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name): a stand-in for a whitelist, the names in documents of quality 1."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return mentions(spark, sf_dir).join(good, "doc_id", "left_semi").select("name").distinct()


GOOD = "SELECT DISTINCT name FROM m WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"


def toxic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name): a stand-in for known false positives, the names in documents marked toxic."""
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return mentions(spark, sf_dir).join(bad, "doc_id", "left_semi").select("name").distinct()


TOXIC = "SELECT DISTINCT name FROM m WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
