"""Totals, rates and the reports over evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("valid_1", "hallucinated_1", "valid_2", "hallucinated_2", "pip_valid", "pip_hallucinated")
#: Evaluated methods in the order of the report, tag and name.
CONTEXTS = {"install_cmd": ("pip_hallucinated", "pip_valid"), "nl_query_1": ("hallucinated_1", "valid_1"), "nl_query_2": ("hallucinated_2", "valid_2"), "bare_import": ("import_hallucinated", "import_valid")}


def rate(hallucinated: Column, valid: Column) -> Column:
    """Per cent of hallucinated names; null where there are none at all."""
    return F.lit(100.0) * F.try_divide(hallucinated.cast("double"), (hallucinated + valid).cast("double"))


def list_totals(df: DataFrame, columns: tuple[str, ...] = COUNTS, by: str | None = None, label: str = "dataset") -> DataFrame:
    """Sums of list lengths, one row for each value of `by` and a row Totals; what is no list counts as 0."""
    sums = [F.sum(F.coalesce(F.size(c), F.lit(0)) if df.schema[c].dataType.typeName() == "array" else F.lit(0)).cast("long").alias(c) for c in columns]
    if by is None:
        return df.agg(*(F.coalesce(s, F.lit(0)).alias(c) for s, c in zip(sums, columns, strict=True)))
    x = df.groupingSets([[F.col(by)], []], F.col(by)).agg(*sums, F.grouping(by).alias("__all"))
    return x.select(F.when(F.col("__all") == 1, "Totals").otherwise(F.col(by)).alias(label), *columns)


def with_totals(totals: DataFrame, label: str = "dataset") -> DataFrame:
    """Given rows of sums and a row Totals below them."""
    names = [c for c in totals.columns if c != label]
    return totals.unionByName(totals.agg(*(F.sum(c).cast("long").alias(c) for c in names)).withColumn(label, F.lit("Totals")))


def context_rates(runs: DataFrame, tag: str = "tag") -> DataFrame:
    """(tag, overall, install_cmd, nl_query_1, nl_query_2, bare_import) from rows of sums; columns that lack count as 0."""
    get = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in runs.columns else F.lit(0)
    hall, valid = (sum((get(p[i]) for p in CONTEXTS.values()), F.lit(0)) for i in (0, 1))
    return runs.select(tag, rate(hall, valid).alias("overall"), *(rate(get(h), get(v)).alias(c) for c, (h, v) in CONTEXTS.items()))


def build_report(runs: DataFrame, tags: list[tuple[str, str]], base: str = "base") -> tuple[DataFrame, DataFrame]:
    """(rates with the absolute reduction against the base run, rates by context) for the runs that are there, in the order of tags; halves go to the even digit."""
    spark = runs.sparkSession
    order = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(tags)], "i int, tag string, Variant string")
    x = context_rates(runs).join(F.broadcast(order), "tag")
    base_rate = x.where(F.col("tag") == base).select(F.max("overall").alias("base_rate"))
    y = x.join(F.broadcast(base_rate.withColumn("one", F.lit(1))), F.lit(1) == F.col("one"), "left")
    reduction = F.when(F.col("tag") == base, F.lit(0.0)).otherwise(F.col("base_rate") - F.col("overall"))
    rates = y.orderBy("i").select("Variant", F.bround("overall", 2).alias("Hallucination Rate (%)"), F.bround(reduction, 2).alias("Abs. Reduction"))
    return rates, x.orderBy("i").select("Variant", *(F.bround(c, 2).alias(c) for c in CONTEXTS))
