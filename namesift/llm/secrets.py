"""Secret scans with an incremental blob ledger, in DataFrame operations alone.

Texts are content-addressed; a ledger records which (blob, rule version) pairs have been scanned and what was
found. An update scans only unseen pairs, whatever paths and versions hold the blob, and findings are joined back
to every path. All offsets are code points, ends exclusive.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namesift.llm.common import shared_dir


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: The group that must be `least` characters long at least; 0 is the whole match.
    group: int
    least: int


#: The order is that of kinds with equal starts. In the second and third rule the length is part of the pattern: a
#: run that is long enough is found from its start, and no part of a shorter one is.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("userinfo", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]+:[^\s/@]+@", 0, 1),
)
#: Changes with any change of RULES: blobs are then scanned again.
VERSION = 1
BASE = ("assign", "access", "hex")
_BLOB = "binary"


def blob(text: str = "text") -> Column:
    """The content address; null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _matches(rule: Rule, order: int) -> Column:
    """An array with a struct for each match: lengths of the text before it (after the last match) and of itself, and whether it counts."""
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    zipped = F.arrays_zip(found.alias("m"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("v"), F.split(text, rule.pattern, -1).alias("g"))
    one = F.transform(zipped, lambda x, i: F.struct(F.lit(order).alias("kind_order"), i.alias("i"), F.length(x["g"]).alias("gap"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("size"), F.coalesce(F.length(x["v"]) >= rule.least, F.lit(False)).alias("counts")))
    return F.when(text.rlike(rule.pattern), one).otherwise(F.array().cast("array<struct<kind_order:int,i:int,gap:int,size:int,counts:boolean>>"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, start, end) of all findings in (blob, text) rows with distinct blobs."""
    text = blobs.select("blob", F.coalesce("text", F.lit("")).alias("text"))
    hits = text.select("blob", F.explode(F.concat(*(_matches(r, i) for i, r in enumerate(rules)))).alias("x")).select("blob", "x.*")
    upto = Window.partitionBy("blob", "kind_order").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(upto)
    spans = hits.withColumn("end", end).where("counts")
    kinds = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("kind_order") + 1)
    return spans.select("blob", kinds.alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")


class Ledger:
    """Two Parquet tables under one path: scans (blob, rule_version) and findings (blob, kind, start, end, rule_version)."""

    SCANS = f"blob {_BLOB}, rule_version int"
    FINDINGS = f"blob {_BLOB}, kind string, start long, end long, rule_version int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def scans(self) -> DataFrame:
        return self._read("scans", self.SCANS)

    def findings(self, version: int = VERSION) -> DataFrame:
        return self._read("findings", self.FINDINGS).where(F.col("rule_version") == version).drop("rule_version")

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, version: int = VERSION) -> None:
        """Scan every text of docs (doc_id, text) that these rules have not seen. Findings are written before the scans, so a run that broke off is made good by the next."""
        docs = docs.select("doc_id", "text")
        held = docs.select("doc_id", blob().alias("blob"))
        unseen = held.groupBy("blob").agg(F.min("doc_id").alias("rep_id")).join(self.scans().where(F.col("rule_version") == version).select("blob").distinct(), "blob", "left_anti")
        seen = self.scans().where(F.col("rule_version") == version)
        rep = unseen.select(F.col("blob").alias("rep_blob"), "rep_id").hint("shuffle_hash")
        texts = docs.join(rep, docs["doc_id"].eqNullSafe(F.col("rep_id")) & (blob() == F.col("rep_blob"))).select(F.col("rep_blob").alias("blob"), "text")
        # rows that repeat an id and its text lead to the same findings; what a broken run left is left out
        found = scan_repeats(texts, rules).join(self.findings(version).select("blob").distinct(), "blob", "left_anti")
        found.withColumn("rule_version", F.lit(version)).write.mode("append").parquet(f"{self.path}/findings")
        unseen.select("blob", F.lit(version).alias("rule_version")).join(seen.select("blob"), "blob", "left_anti").write.mode("append").parquet(f"{self.path}/scans")


def scan_repeats(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """scan() for rows of which some may repeat wholly: each row is scanned by itself, equal findings count once."""
    keyed = texts.withColumn("blob", F.struct(F.col("blob").alias("b"), F.monotonically_increasing_id().alias("row")))
    return scan(keyed, rules).select(F.col("blob.b").alias("blob"), "kind", "start", "end").distinct()


def digest(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs, through the ledger.

    spans: kind:start:end of all findings by start, then by kind in the order of RULES, joined by commas; base_sha256
    is of the same text with the base kinds alone. Null texts count as empty. Without a ledger a new one is begun in
    the shared folder. Repeated rows each give a row.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, f"{shared_dir(spark)}/secrets-{uuid.uuid4().hex}")
    ledger.update(docs)
    order = F.element_at(F.create_map(*(x for i, r in enumerate(RULES) for x in (F.lit(r.kind), F.lit(i)))), F.col("kind"))
    by = ledger.findings().groupBy("blob").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE),
        F.array_sort(F.collect_list(F.struct("start", order.alias("o"), "kind", "end"))).alias("all"),
    )
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    by = by.select("blob", *(f"n_{k}" for k in BASE), joined(F.filter("all", lambda s: s["o"] < len(BASE))).alias("base"), joined(F.col("all")).alias("spans"))
    paths = docs.select("doc_id", blob().alias("blob"))
    return paths.join(by, "blob", "left").select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
