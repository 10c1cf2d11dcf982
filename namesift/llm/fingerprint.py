"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of any two texts can be
compared and merged, and the share of one in the other estimates containment however unequal the texts are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesift.llm import blocks
from namesift.llm.common import partitions, small_batches

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 4
#: Values of a sketch lie below; a mark, the smallest hash of a text that has none below the fraction, does not.
LIMIT = 1 << 32
#: Documents in one range of ids, about.
RANGE_ROWS = 4096


def sketches(raw: list[bytes]) -> list[np.ndarray]:
    """The sorted sketch of each text.

    Words are taken as they are. A text of one to four words is one shingle. Where no hash is below the fraction the
    sketch is a mark, the smallest hash whole: it tells short texts apart and equals no hash that other sketches keep.
    Only texts without words have an empty sketch.
    """
    w = blocks.words(raw, False)
    n = w.hashes.size
    first, last = np.searchsorted(w.text, np.arange(len(raw))), np.searchsorted(w.text, np.arange(len(raw)), side="right")
    h = np.zeros(n, np.uint64)
    left = np.minimum(last[w.text] - np.arange(n), SHINGLE) if n else np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            inside = np.flatnonzero(left > i)
            h[inside] = (h[inside] + w.hashes[inside + i]) * np.uint64(0x9FB21C651E98DF25)
    h = blocks.mix(h) >> np.uint64(30)  # 34 bits, of which a quarter has the two highest unset
    whole = (left == SHINGLE) | ((np.arange(n) == first[w.text]) if n else np.empty(0, bool))
    small = (h < np.uint64((1 << 34) // SCALE)) & whole
    kept = np.concatenate([[0], np.cumsum(small)])
    low = h[small]
    out = []
    for a, b in zip(first, last, strict=True):
        x = np.unique(low[kept[a] : kept[b]])
        if not x.size and b > a:
            x = np.array([h[a:b][whole[a:b]].min()], np.uint64)
        out.append(x)
    return out


def marked(sketch: np.ndarray) -> bool:
    """Whether the sketch has a mark alone."""
    return bool(sketch.size) and int(sketch[-1]) >= LIMIT


def text_of(sketch: np.ndarray) -> str:
    """Eight hex digits a hash; a mark has nine."""
    return f"{int(sketch[0]):09x}" if marked(sketch) else sketch.astype(">u4").tobytes().hex()


def of_text(fingerprint: str) -> np.ndarray:
    return np.array([int(fingerprint, 16)], np.uint64) if len(fingerprint) == 9 else np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint64)


def merge(a: str, b: str) -> str:
    """The fingerprint of two texts' shingles together: their hashes, or the smaller mark where neither has any."""
    x = np.union1d(of_text(a), of_text(b))
    return text_of(x[x < LIMIT] if (x < LIMIT).any() else x[:1])


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a that is in b; two empty sketches are alike, an empty and another are not.

    A mark says nothing about other texts: it is alike to the same mark alone, and whether its text is part of a
    longer one cannot be told from sketches of this fraction. That befalls a text of n shingles with probability
    (1 - 1 / SCALE) ** n; judge those by their texts.
    """
    if not a.size or not b.size:
        return float(a.size == b.size)
    return np.intersect1d(a, b, assume_unique=True).size / a.size


def edited(text: str, other: str) -> str:
    """text with its last third replaced by as many code points (or all) of the start of other."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k] if k else text


def in_ranges(docs: DataFrame) -> DataFrame:
    """(range, own, doc_id, text): documents dealt out by ranges of descending id, each range with a copy (own false) of the first document of the next one.

    The bounds come from the ids alone. After the last range comes the very first document. Null ids go last.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id").where("doc_id is not null")
    n = docs.count()
    ranges = max(1, min(4096, -(-n // RANGE_ROWS)), 4 * partitions(spark) if n > RANGE_ROWS else 1)
    bounds = sorted(set(map(int, ids.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else [])), reverse=True)
    # range i holds the ids below i bounds: a bound itself and the ids above it come before
    at = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col("doc_id") < b)) if bounds else F.lit(0)).cast("int")
    heads = ids.select("doc_id", at.alias("range")).groupBy("range").agg(F.max("doc_id").alias("doc_id")).orderBy("range").collect()  # one row a range
    if not heads and n:  # null ids alone
        heads = [{"range": 0, "doc_id": None}]
    sends = [(h["doc_id"], heads[i - 1]["range"] if i else heads[-1]["range"]) for i, h in enumerate(heads)]
    if n and heads[-1]["range"] != len(bounds) and docs.where("doc_id is null").head(1):
        sends[0] = (sends[0][0], len(bounds))
        sends.append((None, heads[-1]["range"]))
    to = spark.createDataFrame(sends, "head long, send int") if sends else spark.createDataFrame([], "head long, send int")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", at.alias("range")).join(F.broadcast(to), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("range").alias("range"), F.lit(True).alias("own"))
    copy = F.struct(F.col("send").alias("range"), F.lit(False).alias("own"))
    x = x.withColumn("x", F.explode(F.when(F.col("send").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    return x.select("x.range", "x.own", "doc_id", "text")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, those of its own first, then by falling id and text."""

    def flush(docs: list[tuple[int | None, str]], follow: str):
        texts = [t for _, t in docs] + [follow]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        raw = [c.encode() for c in changed]
        own, new = sketches([t.encode() for t in texts]), sketches(raw)
        cols = {"doc_id": [d for d, _ in docs], "n_chars": [len(t) for _, t in docs], "edited_sha256": [hashlib.sha256(x).hexdigest() for x in raw], "fingerprint": [text_of(x) for x in own[:-1]], "edited_fingerprint": [text_of(x) for x in new],
                "near_edited": [containment(a, b) for a, b in zip(own, new, strict=False)], "near_next": [containment(a, b) for a, b in zip(own, own[1:], strict=False)]}
        return pa.RecordBatch.from_pydict(cols, schema=pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]))

    held: list[tuple[int | None, str]] = []
    size, current, ended = 0, None, False
    for b in batches:
        for r, own, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            if r != current:
                if held:
                    yield flush(held, held[0][1] if current is None else "")
                held, size, current, ended = [], 0, r, False
            if not own:
                if not ended and held:  # the first document past the range
                    yield flush(held, text)
                    held, size = [], 0
                ended = True
                continue
            if size > blocks.BLOCK // 2:
                *done, last = held
                if done:
                    yield flush(done, last[1])
                    held, size = [last], len(last[1])
            held.append((doc_id, text))
            size += len(text)
    if held:
        yield flush(held, "")


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how much of the first is in the second and in the next document's.

    The next document is that of the next lower doc_id (repeated ids by text, null ids last), after the last the
    first. The edited text has its last third replaced by the start of the next text. Null texts count as empty: an
    empty fingerprint, alike only to another empty one. A single document is its own next. One shuffle of the texts.
    """
    small_batches(docs.sparkSession)
    dealt = in_ranges(docs).repartition("range").sortWithinPartitions("range", F.desc("own"), F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    return dealt.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
