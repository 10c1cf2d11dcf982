"""Merkle manifest of a dataset: a radix-ranked trie of fanout 16 over each source's leaves, and one over the sources.

Exact ranks come without a global sort: keys are fixed strings of hex digits, their prefixes are counted at one depth
where the buckets are small, counts are added up to coarser prefixes, and a bucket's offset is that of its parent plus
the counts of its smaller siblings. Only rows of one small bucket are sorted. The hex digits of a rank are a node's
place in the trie. Nodes are reduced from the longest prefix on, three digits a shuffle: 4096 consecutive nodes lie in
one row and give one node of the next round. Ways to the root go down the same rows.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesift.llm.common import materialise

FANOUT = 16
#: Levels that one round reduces, and the nodes in one row for it.
LEVELS = 3
CHUNK = FANOUT**LEVELS
#: Rows of a bucket that are aimed at, and the most that are sorted together as long as keys can be told apart.
BUCKET, MOST = 256, 4096
#: Hex digits by which prefixes get coarser: at most 4096 siblings are added up together.
DIGITS = 3
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of the fields in order: `-` for null, else the length in bytes of UTF-8, a colon and the value."""
    parts = []
    for name in FIELDS:
        x = fields[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    return digest(F.concat(*parts))


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digits(x: Column) -> Column:
    return F.lpad(F.hex(x), 16, "0")


def radix_ranks(rows: DataFrame, group: str, key: str) -> DataFrame:
    """rows with rank (from 0, in the order of `key` within `group`) and total (rows of the group).

    rows: a written table. key: hex digits, unlike within a group and none the start of another, or of any length where
    the order of strings is meant. Depth grows until no bucket has more than MOST rows, in steps that follow from the
    largest one; each step counts prefixes with partial sums, so a hot group costs its tasks nothing more.
    """
    lo, hi, longest = rows.agg(F.min(key), F.max(key), F.max(F.length(key))).first()
    base = len(os.path.commonprefix([lo, hi]))
    depth, largest, step = base, rows.count(), 1
    while True:
        step = max(step, math.ceil(math.log(max(2, largest / BUCKET), 16)))
        depth = min(depth + step, max(longest, 1))
        counts = materialise(rows.groupBy(group, F.substring(key, 1, depth).alias("prefix")).agg(F.count("*").alias("n")), "digit-counts")
        was, largest = largest, counts.agg(F.max("n")).first()[0]
        if largest <= MOST or depth >= longest:
            break
        step = 2 * step if 2 * largest > was else 1
    at = _offsets(counts, group, depth, base).select(F.col(group).alias("__group"), F.col("prefix").alias("__prefix"), "offset", "total")
    x = rows.withColumn("__at", F.substring(key, 1, depth)).join(at, (F.col(group) == F.col("__group")) & (F.col("__at") == F.col("__prefix")))
    inside = F.row_number().over(Window.partitionBy("__group", "__prefix").orderBy(key)) - 1
    return x.withColumn("rank", F.col("offset") + inside).drop("__at", "__group", "__prefix", "offset")


def _offsets(counts: DataFrame, group: str, depth: int, base: int) -> DataFrame:
    """counts (group, prefix, n) with offset (rows of the group with smaller prefixes) and total: siblings are added up below their parents alone."""
    up = max(base, depth - DIGITS)
    x = counts.withColumn("parent", F.substring("prefix", 1, up) if up else F.lit(""))
    siblings = Window.partitionBy(group, "parent").orderBy("prefix")
    x = x.withColumn("before", F.coalesce(F.sum("n").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if up <= base:  # all rows have this parent
        return x.select(group, "prefix", F.col("before").alias("offset"), F.sum("n").over(Window.partitionBy(group, "parent")).alias("total"))
    parents = _offsets(x.groupBy(group, F.col("parent").alias("prefix")).agg(F.sum("n").alias("n")), group, up, base)
    parents = parents.select(F.col(group).alias("__g"), F.col("prefix").alias("__p"), F.col("offset").alias("__o"), "total")
    return x.join(parents, (F.col(group) == F.col("__g")) & (F.col("parent") == F.col("__p"))).select(group, "prefix", (F.col("__o") + F.col("before")).alias("offset"), "total")


def _levels(total: Column) -> Column:
    """Levels above the nodes of a group until one is left."""
    n = F.lit(0)
    for i in range(15):
        n = n + (total > FANOUT**i).cast("int")
    return n


def _runs(nodes: Column) -> Column:
    """The digests of each 16 consecutive nodes."""
    last = F.floor((F.size(nodes) - 1) / FANOUT).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), "")))


def _once(x: DataFrame, name: str, value: Column) -> DataFrame:
    """x with a column that is made once for each row, not anew in each expression over it."""
    return x.withColumn(name, F.explode(F.array(value)))


def build(nodes: DataFrame, payload: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of a trie, and its tops.

    nodes: grp, rank, h, total and the payload. A round is a written table of (grp, chunk, total, levels, items, l0, l1,
    l2): the nodes of a chunk in order with their payload, and the digests of its levels. tops: (grp, h), one a group.
    """
    rounds = []
    while True:
        own = payload if not rounds else []
        items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "h", *own))), lambda s: s)
        x = nodes.groupBy("grp", F.floor(F.col("rank") / CHUNK).alias("chunk")).agg(F.first("total").alias("total"), items.alias("items"))
        x = x.withColumn("levels", F.least(F.lit(LEVELS), F.greatest(F.lit(0), _levels(F.col("total")) - LEVELS * len(rounds))))
        x = _once(x, "l0", F.transform("items", lambda s: s["h"]))
        for i in range(1, LEVELS):
            x = _once(x, f"l{i}", F.when(F.col("levels") > i, _runs(F.col(f"l{i - 1}"))).otherwise(F.col(f"l{i - 1}")))
        # a chunk of a group that goes on is one node after its levels; of another it holds all that is left
        below = F.col("l0")
        for i in range(1, LEVELS):
            below = F.when(F.col("levels") > i, F.col(f"l{i}")).otherwise(below)
        x = x.withColumn("top", F.when(F.col("levels") == 0, F.col("l0")[0]).otherwise(_runs(below)[0]))
        made = materialise(x, f"{name}-{len(rounds)}")
        rounds.append(made)
        nodes = made.select("grp", F.col("chunk").alias("rank"), F.col("top").alias("h"), "total")
        # a round's last level has one node where no more than CHUNK ** round were there
        if made.agg(F.max("chunk")).first()[0] == 0:
            return rounds, nodes.select("grp", "h")


def _ways(x: DataFrame) -> Column:
    """For each node of a chunk its siblings on each level, as (left, right), up to the root."""

    def level(i: Column, j: int) -> Column:
        at = F.floor(i / FANOUT**j).cast("int")
        first = at - at % FANOUT
        nodes = F.col(f"l{j}")
        return F.struct(F.array_join(F.slice(nodes, first + 1, at % FANOUT), "").alias("left"), F.array_join(F.slice(nodes, at + 2, FANOUT - 1 - at % FANOUT), "").alias("right"))

    def way(i: Column) -> Column:
        own = F.array(*(level(i, j) for j in range(LEVELS)))
        return F.concat(F.slice(own, F.lit(1), F.col("levels")), F.col("way"))

    return F.transform("items", lambda s, i: F.struct(s.alias("item"), way(i).alias("way")))


def fold(way: Column, start: Column) -> Column:
    """The root over a leaf and its siblings."""
    return F.aggregate(way, start, lambda h, p: digest(F.concat(p["left"], h, p["right"])))


def descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(grp, item, way) and the other columns of tops, for each node of the first round.

    tops: (grp, way) and more, one row a group: the way from a group's top to the root.
    """
    carried = [c for c in tops.columns if c not in ("grp", "way")]
    above = tops.withColumn("chunk", F.lit(0).cast("long"))
    for made in reversed(rounds):
        up = above.select(F.col("grp").alias("__g"), F.col("chunk").alias("__c"), "way", *carried)
        x = made.join(up, (F.col("grp") == F.col("__g")) & (F.col("chunk") == F.col("__c")))
        x = x.select("grp", *carried, F.inline(_ways(x)))
        above = x.select("grp", F.col("item.rank").alias("chunk"), "way", *carried)
    return x


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of documents.

    A leaf is the digest of a row's five fields. Per source leaves ascend by doc_id (nulls first); equal ids go by
    their leaf, wholly equal rows are leaves of their own side by side. While several nodes remain, each 16 consecutive
    ones become the digest of their joined digests; one leaf is its own subroot. Subroots by source (null first, bytes
    of UTF-8) make the root in the same way. proof_sha256 is the digest of all siblings on the way up. folded_root is
    the root over the row's own leaf and its siblings, over the lower-cased text (A to Z) where 5 divides the crc32
    of the id; rows without an id are not tampered with. Null and empty texts differ. An empty table gives no rows.
    Other columns of docs play no part. Lone rows or sources, any number of either, and one source with most rows are
    all the same to it.
    """
    spark = docs.sparkSession
    fields = {c: F.col(f"`{c}`") for c in FIELDS}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    grp = F.coalesce(F.concat(F.lit("1"), F.hex(F.col("source").cast("string"))), F.lit("0"))
    ident = F.coalesce(F.concat(F.lit("1"), _digits(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63))))), F.lit("0"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), grp.alias("grp"), ident.alias("ident"), leaf(fields).alias("h"),
        F.when(tampered, leaf(fields | {"text": lower_ascii(F.col("text"))})).alias("other"), F.monotonically_increasing_id().alias("tie"),
    )
    leaves = materialise(rows, "leaves")
    if leaves.isEmpty():
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    # ids alone where they tell all rows apart; digits of leaf and row number after them are read only if buckets ask for it
    keyed = leaves.select("doc_id", "grp", "h", "other", F.concat("ident", "h", _digits(F.col("tie"))).alias("key"))
    ranked = radix_ranks(keyed, "grp", "key").select("grp", "rank", "total", "h", "doc_id", "other")
    own, subroots = build(ranked, ["doc_id", "other"], "leaf-trie")
    sources = materialise(subroots.select(F.lit("").alias("all"), F.col("grp").alias("key"), "h"), "subroots")
    of_sources = radix_ranks(sources, "all", "key").select(F.col("all").alias("grp"), "rank", "total", "h", F.col("key").alias("source"))
    top, root = build(of_sources, ["source"], "source-trie")
    no_way = F.array().cast("array<struct<left:string,right:string>>")
    ways = descend(top, root.select("grp", no_way.alias("way"), F.col("h").alias("root")))
    x = descend(own, ways.select(F.col("item.source").alias("grp"), "way", F.col("item.h").alias("subroot"), "root"))
    item, way = F.col("item"), F.col("way")
    proof = digest(F.array_join(F.transform(way, lambda p: F.concat(p["left"], p["right"])), ""))
    x = x.select(item["doc_id"].alias("doc_id"), item["h"].alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), fold(way, F.coalesce(item["other"], item["h"])).alias("folded_root"))
    return x.withColumn("verified", F.col("folded_root") == F.col("root"))
