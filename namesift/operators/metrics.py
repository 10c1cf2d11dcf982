"""Likelihood metrics over per-token scores: min-k means, perplexity, accuracy, ROC-AUC, masked losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesift.operators.align import sums_before

RATIOS = (0.3, 0.4, 0.5, 0.6, 1.0)


def masked(values: Column, mask: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda z: z["m"]), lambda z: z["v"])


def min_k(log_probs: Column, ratio: Column | float) -> Column:
    """Mean of the int(ratio * n) lowest; null where that is none."""
    r = F.lit(ratio) if isinstance(ratio, float) else ratio
    k = F.floor(r * F.size(log_probs)).cast("int")
    low = F.slice(F.array_sort(log_probs), F.lit(1), k)
    return F.when(k > 0, F.try_divide(F.aggregate(low, F.lit(0.0), lambda a, x: a + x), k.cast("double")))


def min_k_accuracy(log_probs: Column, hits: Column, ratio: float) -> Column:
    """Share of hits among the int(ratio * n) tokens of the lowest scores, the earlier of equals first."""
    k = F.floor(F.lit(ratio) * F.size(log_probs)).cast("int")
    ranked = F.array_sort(F.transform(F.arrays_zip(log_probs.alias("p"), hits.alias("h")), lambda z, i: F.struct(z["p"].alias("p"), i.alias("i"), z["h"].alias("h"))))
    return F.when(k > 0, F.try_divide(F.size(F.filter(F.slice(ranked, F.lit(1), k), lambda z: z["h"])).cast("double"), k.cast("double")))


def by_ratio(scores: DataFrame, ratios: tuple[float, ...] = RATIOS, log_probs: str = "log_probs") -> DataFrame:
    """scores with ratio and min_k, one row for each ratio; rows without a value are gone."""
    x = scores.withColumn("ratio", F.explode(F.array(*map(F.lit, ratios))))
    return x.withColumn("min_k", min_k(F.col(log_probs), F.col("ratio"))).where("min_k is not null")


def sample_weighted(df: DataFrame, mean: str, accuracy: str | None = None, by: str | None = None) -> DataFrame:
    """Perplexity of the mean of sample means, and mean accuracy in per cent."""
    aggs = [F.exp(-F.avg(mean)).alias("ppl")] + ([(100 * F.avg(accuracy)).alias("accuracy")] if accuracy else [])
    return df.groupBy(*([by] if by else [])).agg(*aggs)


def token_weighted(df: DataFrame, log_probs: str = "log_probs", hits: str | None = None, by: str | None = None) -> DataFrame:
    """nll, ppl (and accuracy) over all tokens."""
    total = F.sum(F.aggregate(log_probs, F.lit(0.0), lambda a, x: a + x))
    n = F.sum(F.size(log_probs)).cast("double")
    nll = F.try_divide(-total, n)
    aggs = [nll.alias("nll"), F.exp(nll).alias("ppl")]
    if hits:
        aggs.append((100 * F.try_divide(F.sum(F.size(F.filter(hits, lambda h: h))).cast("double"), n)).alias("accuracy"))
    return df.groupBy(*([by] if by else [])).agg(*aggs)


def auc(df: DataFrame, score: str, label: Column, by: list[str] = [], parts: int | None = None) -> DataFrame:  # noqa: B006
    """Area under the ROC curve by average ranks; null where a class is empty.

    Scores are counted by value first, so what is ranked are distinct values, and equal scores cost no more. Ranks are
    sums over ranges of scores, so that no task has all scores of a group.
    """
    counts = df.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("n"))
    x = sums_before(counts, "s", F.col("n"), "below", by, parts)
    wins = F.sum(F.col("p").cast("double") * (F.col("below") + F.col("n") / 2))
    return x.groupBy(*by).agg(F.try_divide(wins, F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def response_score(df: DataFrame, log_probs: str = "log_probs", start: str = "response_start") -> Column:
    """Mean log-probability of the tokens from the answer's start on."""
    own = F.slice(log_probs, F.col(start) + 1, F.greatest(F.size(log_probs) - F.col(start), F.lit(0)))
    return min_k(own, 1.0)


def _mean(x: Column, on: Column) -> Column:
    return F.coalesce(F.avg(F.when(on, x)), F.lit(0.0))


def ga_loss(tokens: DataFrame, retain: float = 1.0, forget: float = 0.5, eos: float = 2.0, by: str | None = None) -> DataFrame:
    """Tri-mask gradient-ascent loss over token losses (ce, mask, is_eos): parts without tokens are 0."""
    ce, m, e = F.col("ce"), F.col("mask"), F.col("is_eos")
    x = tokens.groupBy(*([by] if by else [])).agg(_mean(ce, (m == 1) & ~e).alias("l_retain"), _mean(ce, m == 2).alias("l_forget"), _mean(ce, (m == 1) & e).alias("l_eos"))
    return x.withColumn("loss", retain * F.col("l_retain") - forget * F.col("l_forget") + eos * F.col("l_eos"))


def npo_loss(tokens: DataFrame, retain: float = 1.0, forget: float = 0.5, eos: float = 2.0, beta: float = 0.1, alpha: float = 0.7, gamma: float = 0.3, by: str | None = None) -> DataFrame:
    """As ga_loss, with alpha * mean softplus(beta * log p) + gamma * mean kl on forget tokens, added; kl (given, from full logits) counts as 0 where the column lacks."""
    ce, m, e = F.col("ce"), F.col("mask"), F.col("is_eos")
    kl = F.col("kl") if "kl" in tokens.columns else F.lit(0.0)
    soft = F.log1p(F.exp(beta * -ce))
    x = tokens.groupBy(*([by] if by else [])).agg(_mean(ce, (m == 1) & ~e).alias("l_retain"), (alpha * _mean(soft, m == 2) + gamma * _mean(kl, m == 2)).alias("l_forget"), _mean(ce, (m == 1) & e).alias("l_eos"))
    return x.withColumn("loss", retain * F.col("l_retain") + forget * F.col("l_forget") + eos * F.col("l_eos"))


def plain_loss(tokens: DataFrame, retain: float = 1.0, forget: float = 0.5, npo: bool = False, beta: float = 0.1, alpha: float = 0.7) -> DataFrame:
    """Loss by whole rows (split_type) and without an end-mark term."""
    ce, f = F.col("ce"), F.col("split_type") == "forget"
    x = tokens.agg(_mean(ce, ~f).alias("l_retain"), (alpha * _mean(F.log1p(F.exp(beta * -ce)), f) if npo else _mean(ce, f)).alias("l_forget"))
    return x.withColumn("loss", retain * F.col("l_retain") + (forget if npo else -forget) * F.col("l_forget"))
