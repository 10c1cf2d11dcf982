"""Steering directions: pooled activations, mean differences, norms, cosines, and the sweep over settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesift.operators.align import layer_pairs


def pool(states: DataFrame, how: str) -> DataFrame:
    """(sample_id, package_name, is_hallucinated, layer, vec) from token states (.., layer, pos, vec) and name spans (positions, package_start, boundary) on the same rows."""
    if how in ("package_start", "boundary"):
        return states.where(F.col("pos") == F.col(how)).select("sample_id", "package_name", "is_hallucinated", "layer", "vec")
    if how != "mean":
        raise ValueError(f"unknown pooling {how}")
    x = states.where(F.array_contains("positions", F.col("pos"))).select("sample_id", "package_name", "is_hallucinated", "layer", F.posexplode("vec").alias("dim", "v"))
    by = x.groupBy("sample_id", "package_name", "is_hallucinated", "layer", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return by.groupBy("sample_id", "package_name", "is_hallucinated", "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"].cast("float")).alias("vec"))


def mean_difference(activations: DataFrame, positive: Column, layer: str = "layer", vec: str = "vec") -> DataFrame:
    """(layer, dim, pos_mean, neg_mean, value): per layer and dimension the mean where `positive` holds less the mean elsewhere. Averages are partial before the shuffle; its size is layers times dimensions."""
    x = activations.select(F.col(layer).alias("layer"), positive.alias("p"), F.posexplode(vec).alias("dim", "v"))
    v = F.col("v").cast("double")
    by = x.groupBy("layer", "dim").agg(F.avg(F.when(F.col("p"), v)).alias("pos_mean"), F.avg(F.when(~F.col("p"), v)).alias("neg_mean"))
    return by.withColumn("value", F.col("pos_mean") - F.col("neg_mean"))


def require_both(activations: DataFrame, positive: Column) -> None:
    a, b = activations.agg(F.count_if(positive), F.count_if(~positive)).first()
    if not a or not b:
        raise ValueError("a class has no activations")


def layer_stats(means: DataFrame) -> DataFrame:
    """(layer, norm, cosine): length of each direction, and the cosine between its two means."""
    s = lambda c: F.sum(c)
    by = means.groupBy("layer").agg(F.sqrt(s(F.col("value") ** 2)).alias("norm"), s(F.col("pos_mean") * F.col("neg_mean")).alias("d"), s(F.col("pos_mean") ** 2).alias("a"), s(F.col("neg_mean") ** 2).alias("b"))
    return by.select("layer", "norm", F.try_divide(F.col("d"), F.sqrt(F.col("a") * F.col("b"))).alias("cosine"))


def as_arrays(means: DataFrame) -> DataFrame:
    return means.groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("vec"))


def layer_deltas(means: DataFrame, which: str = "adjacent") -> DataFrame:
    """(layer_from, layer_to, delta_norm, cos_between, cos_hall_vs_val): how directions and both means' changes differ between layers."""
    pairs = layer_pairs(means, which)
    a = means.select(F.col("layer").alias("layer_from"), "dim", F.col("value").alias("v0"), F.col("pos_mean").alias("p0"), F.col("neg_mean").alias("n0"))
    b = means.select(F.col("layer").alias("layer_to"), "dim", F.col("value").alias("v1"), F.col("pos_mean").alias("p1"), F.col("neg_mean").alias("n1"))
    x = pairs.join(a, "layer_from").join(b, ["layer_to", "dim"])
    s, c = F.sum, F.col
    dp, dn = c("p1") - c("p0"), c("n1") - c("n0")
    by = x.groupBy("layer_from", "layer_to").agg(
        F.sqrt(s((c("v1") - c("v0")) ** 2)).alias("delta_norm"), F.try_divide(s(c("v0") * c("v1")), F.sqrt(s(c("v0") ** 2) * s(c("v1") ** 2))).alias("cos_between"),
        F.try_divide(s(dp * dn), F.sqrt(s(dp**2) * s(dn**2))).alias("cos_hall_vs_val"),
    )
    return by


def largest_jump(deltas: DataFrame) -> DataFrame:
    return deltas.agg(F.max_by(F.struct("layer_from", "layer_to"), "delta_norm").alias("x"), F.max("delta_norm").alias("delta_norm")).select("x.*", "delta_norm")


def judge_pairs(scores: DataFrame) -> DataFrame:
    """Pair scores with margin, whether the matching answer wins (ties win), and which is chosen."""
    m, n = F.col("matching_score"), F.col("not_matching_score")
    return scores.withColumns({"score_margin": m - n, "is_matching": m >= n, "chosen": F.when(m >= n, "matching").otherwise("not_matching")})


def sweep(pairs: DataFrame) -> DataFrame:
    """One row for each layer and multiplier: samples, accuracy, failure rate, mean score and mean margin."""
    ok = F.avg(F.col("is_matching").cast("double"))
    return pairs.groupBy("layer", "multiplier").agg(F.count("*").alias("num_samples"), ok.alias("matching_accuracy"), (1 - ok).alias("pairwise_failure_rate"), F.avg("matching_score").alias("mean_matching_score"), F.avg("score_margin").alias("mean_margin"))


def best(summary: DataFrame, order: tuple[str, ...] = ("layer", "multiplier"), num_samples: int | None = None) -> DataFrame:
    """The row of highest accuracy, then margin, the first in `order` of equals; incomplete rows and rows over another number of samples do not count."""
    x = summary.where("matching_accuracy is not null and mean_margin is not null")
    if num_samples is not None:
        x = x.where(F.col("num_samples") == num_samples)
    return x.orderBy(F.desc("matching_accuracy"), F.desc("mean_margin"), *order).limit(1)


def pending_cells(layers: list[int], multipliers: list[float], done: DataFrame | None, spark) -> DataFrame:
    """The grid of settings without those that have results."""
    grid = spark.createDataFrame([(a, float(m)) for a in layers for m in multipliers], "layer int, multiplier double")
    return grid if done is None else grid.join(done.select("layer", "multiplier"), ["layer", "multiplier"], "left_anti")


def steer(scores: DataFrame, layers: list[int], multipliers: list[float], done: DataFrame | None = None) -> DataFrame:
    """The sweep over all cells of the grid: cells with results keep them, the others are made from pair scores."""
    cells = pending_cells(layers, multipliers, done, scores.sparkSession)
    new = sweep(judge_pairs(scores.join(F.broadcast(cells), ["layer", "multiplier"], "left_semi")))
    return new if done is None else new.unionByName(done.select(*new.columns))


