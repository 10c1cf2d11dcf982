"""Mixing sources to target weights by pivotal dependent rounding.

Each source's documents share a fractional number of copies. Pairs of documents hand words from one to the other,
at random and without bias, until one has a whole number of copies. Every group of a fixed hash bucket leaves one
document with a fraction; those meet again, sixteen buckets at a time, up a reduction tree, so a source's words
stay at their target up to the last document of the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namesift.llm.common import WORD, materialise

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Times its source's size that a target may be at most.
MOST = 3
FAN_IN = 16
#: Documents in one bucket of the tree's lowest level, about.
BUCKET_ROWS = 16_384
_UNITS = "source string, bucket long, doc_id long, h long, size long, rows long, base long, part double, done boolean"


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, h, size, rows): words of each distinct text of an id and source; rows counts its repeats."""
    h, size = F.xxhash64("text"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), h.alias("h"), size.alias("size"))
    return narrow.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("rows"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target): all sizes shared out by weight, no source above MOST times its size, the excess going to the others by weight.

    In order of size over weight the capped sources come first; one running sum finds where they end. One row for
    each source is all that meets here.
    """
    by = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    big = "decimal(38,0)"
    x = by.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("long"))
    x = x.withColumn("cap", F.col("source_size") * MOST)
    before = Window.orderBy((F.col("cap") / F.col("w")), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast(big)
    weight_left = (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).cast(big)
    x = x.withColumns({"left": left, "weight_left": weight_left})
    x = x.withColumn("capped", F.col("cap").cast("decimal(18,0)") * F.col("weight_left").cast("decimal(18,0)") <= F.col("w").cast("decimal(18,0)") * F.col("left").cast("decimal(18,0)"))
    level = F.max(F.when(~F.col("capped"), F.col("left").cast("double") / F.col("weight_left").cast("double"))).over(every)
    return x.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * level)).select("source", "source_size", "target")


def _uniform(seed: int, level: int, doc_id: int | None, h: int | None) -> float:
    d = hashlib.blake2b(f"{seed}|{level}|{doc_id}|{h}".encode(), digest_size=8).digest()
    return (int.from_bytes(d, "big") + 0.5) / 2**64


def pivot(seed: int, level: int, a: dict, b: dict) -> tuple[list[dict], dict | None]:
    """Hand words between two documents until one has a whole part; ([those done], the one that is not)."""
    wa, wb = a["size"] * a["rows"], b["size"] * b["rows"]
    to_b, to_a = min(wa * a["part"], wb * (1 - b["part"])), min(wa * (1 - a["part"]), wb * b["part"])
    give = _uniform(seed, level, b["doc_id"], b["h"]) * (to_a + to_b) < to_a
    x, y = (b, a) if give else (a, b)  # x gains, y loses
    wx, wy = (wb, wa) if give else (wa, wb)
    room, stock = wx * (1 - x["part"]), wy * y["part"]
    if abs(room - stock) <= 1e-9 * max(wx, wy):
        x["part"], y["part"] = 1.0, 0.0
        return [x, y], None
    if room < stock:
        x["part"], y["part"] = 1.0, y["part"] - room / wy
        return [x], y
    x["part"], y["part"] = x["part"] + stock / wx, 0.0
    return [y], x


def _level(seed: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if held is not None and (held["source"], held["bucket"]) != (r["source"], r["bucket"]):
                    out.append(held)
                    held = None
                if r["part"] <= 0 or r["part"] >= 1 or not r["size"]:
                    out.append(r | {"done": True})
                elif held is None:
                    held = r
                else:
                    done, held = pivot(seed, level, held, r)
                    out += [x | {"done": True} for x in done]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=b.schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], schema=b.schema)

    return run


def copies(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, h, size, rows, source_size, target, copies) for each distinct text of an id and source.

    copies is the floor or the ceiling of target / source_size, so never above MOST; the same for each of the `rows`
    repeats. Documents without words get no copies. The result depends on the rows and the seed alone.
    """
    sized = materialise(sizes(docs), "mixing-sizes")
    goal = materialise(targets(sized), "mixing-targets")
    n, levels = sized.count(), 0
    while BUCKET_ROWS * FAN_IN**levels < n:
        levels += 1
    ratio = F.col("target") / F.col("source_size")
    units = (
        sized.where("size > 0").alias("s").join(F.broadcast(goal) if goal.count() <= 10_000 else goal, F.expr("s.source").eqNullSafe(goal["source"])).select("s.*", "source_size", "target")
        .withColumn("base", F.floor(F.least(ratio, F.lit(float(MOST)))).cast("long")).withColumn("part", F.least(ratio, F.lit(float(MOST))) - F.col("base"))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(FAN_IN**levels))).withColumn("done", F.lit(False))
    )
    names = [x.split()[0] for x in _UNITS.split(", ")]
    settled = []
    open_ = units.select(*names)
    for level in range(levels + 1):
        if level:
            open_ = open_.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        dealt = open_.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.desc("size"), "doc_id", "h")
        ran = materialise(dealt.mapInArrow(_level(seed, level), _UNITS), "mixing-level")
        settled.append(ran.where("done"))
        open_ = ran.where("not done")
    settled.append(open_.withColumn("part", F.when(F.col("part") >= 0.5, 1.0).otherwise(0.0)))  # at most one document of each source
    every = settled[0]
    for x in settled[1:]:
        every = every.unionByName(x)
    taken = every.select("doc_id", "h", "source", "size", "rows", (F.col("base") + F.round("part").cast("long")).alias("copies"))
    taken = taken.unionByName(sized.where("size = 0").select("doc_id", "h", "source", "size", "rows", F.lit(0).cast("long").alias("copies")))
    goal = goal.withColumnRenamed("source", "g_source")
    goal = F.broadcast(goal) if goal.count() <= 10_000 else goal
    return taken.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs with each row as often as its copies say; the columns of docs."""
    c = copies(docs, seed).where("copies > 0").select(*(F.col(x).alias(f"__mix_{x}") for x in ("doc_id", "h", "source", "copies"))).hint("shuffle_hash")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__mix_doc_id")) & F.xxhash64("text").eqNullSafe(F.col("__mix_h")) & F.col("source").cast("string").eqNullSafe(F.col("__mix_source"))
    repeated = docs.join(c, same).withColumn("__mix_i", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int"))))
    return repeated.drop("__mix_doc_id", "__mix_h", "__mix_source", "__mix_copies", "__mix_i")


def report(docs: DataFrame, seed: int = 1) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, source, copies. Null texts have no words; a null source is a source."""
    c = copies(docs, seed).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return c.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
