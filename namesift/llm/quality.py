"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of pairs of folded characters, and the share of its five-word shingles that repeat. Inverse
document frequencies and a truncated singular value decomposition are fitted to a bounded sample of labelled
texts; their vectors are broadcast, and every document's exact cosines with all of them are taken block by block.
The nearest vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesift.llm import blocks
from namesift.llm.common import id_remainder, small_batches

_FOLDS = 64
_TERMS = _FOLDS * _FOLDS + 2
#: Bytes of texts and their counts that are held at once (a longer text alone); each text has _TERMS counts.
_BYTES = 1 << 20
SHINGLE = 5


def _fold() -> np.ndarray:
    """A class for each byte: small letters each their own; capitals, digits and bytes past ASCII in few; other signs each their own."""
    out = np.full(256, 63, np.uint8)
    for b in range(256):
        if 97 <= b <= 122:
            out[b] = b - 97
        elif 65 <= b <= 90:
            out[b] = 26 + (b - 65) % 2
        elif 48 <= b <= 57:
            out[b] = 28
        elif b == 32:
            out[b] = 29
        elif b == 10:
            out[b] = 30
        elif b < 32:
            out[b] = 31
        elif b >= 128:
            out[b] = 60 + b % 3
    for i, b in enumerate(x for x in range(33, 127) if not chr(x).isalnum()):
        out[b] = 32 + i % 28
    return out


_CLASS = _fold()


def repeated_shingles(w: blocks.Words, n: int) -> np.ndarray:
    """For each of n texts the share of its five-word shingles that occurred before in the same text; 0 without any."""
    if w.hashes.size < SHINGLE:
        return np.zeros(n)
    m = w.hashes.size - SHINGLE + 1
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            h = (h + w.hashes[i : i + m]) * np.uint64(0x9FB21C651E98DF25)
    inside = w.text[:m] == w.text[SHINGLE - 1 :]
    h, text = h[inside], w.text[:m][inside]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    again = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    every = np.bincount(text, minlength=n)
    return np.bincount(text[1:][again], minlength=n) / np.maximum(every, 1)


def terms(raw: list[bytes]) -> np.ndarray:
    """Square roots of term shares, one row for each text; zero for a text without words."""
    buf = np.frombuffer(b"".join(x + b" " for x in raw), np.uint8)
    fold = _CLASS[buf].astype(np.int64)
    ends = np.cumsum([len(x) + 1 for x in raw])
    text = np.repeat(np.arange(len(raw)), np.diff(ends, prepend=0))
    key = (text[:-1] * _FOLDS + fold[:-1]) * _FOLDS + fold[1:]
    counts = np.bincount(key, minlength=len(raw) * _FOLDS * _FOLDS).reshape(len(raw), -1).astype(np.float32)
    w = blocks.words(raw, False)
    some = np.bincount(w.text, minlength=len(raw)) > 0
    again = repeated_shingles(w, len(raw)).astype(np.float32)
    out = np.zeros((len(raw), _TERMS), np.float32)
    out[:, :-2] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    out[:, -2], out[:, -1] = np.sqrt(again), np.sqrt(1 - again)
    return out * some[:, None]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Voter:
    """Latent-semantic vectors of labelled texts, and the vote of the nearest."""

    def __init__(self, x: np.ndarray, y: np.ndarray, dims: int = 96, neighbours: int = 9, power: float = 8.0):
        self.neighbours, self.power = neighbours, power
        df = (x > 0).sum(0)
        self.idf = (np.log((1 + len(x)) / (1 + df)) + 1).astype(np.float32)
        a = x * self.idf
        rng = np.random.default_rng(7)
        dims = min(dims, *a.shape) if len(a) else 1
        basis = rng.standard_normal((a.shape[1], min(dims + 16, a.shape[1]))).astype(np.float32)
        for _ in range(4):  # subspace iteration towards the leading right singular vectors
            basis, _ = np.linalg.qr(a.T @ (a @ basis)) if len(a) else (basis, None)
        _, _, vt = np.linalg.svd(a @ basis, full_matrices=False) if len(a) else (None, None, np.eye(basis.shape[1]))
        del a
        self.project = np.ascontiguousarray(basis @ vt[:dims].T, np.float32) * self.idf[:, None]
        self.vectors, self.labels = _unit(x @ self.project), y.astype(np.float32)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1; 0 for texts without terms, 0.5 where nothing is learnt."""
        if not len(self.labels):
            return np.full(len(x), 0.5)
        near = _unit(x @ self.project) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.clip(np.take_along_axis(near, at, 1), 1e-6, 1).astype(np.float64) ** self.power
        return np.where(x.any(1), np.clip((w * self.labels[at]).sum(1) / w.sum(1), 0, 1), 0.0)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = terms([(t or "").encode() for t in b.column(0).to_pylist()]).astype(np.float16)
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, modulus: int = 4, held_out: int = 2) -> Voter:
    """Learn from at most `sample` labelled documents (the first by a hash of their ids), never from those whose crc32(doc_id as text) mod `modulus` is `held_out`.

    labels: (doc_id, quality); null qualities count as none, of several for one id the lowest holds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("quality is not null and doc_id is not null").where(id_remainder("doc_id", modulus) != held_out).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = known.join(docs.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    at_hand = spark.createDataFrame(ids.toPandas(), "doc_id long, quality int")  # at most `sample` ids
    found = docs.select("doc_id", "text").join(F.broadcast(at_hand), "doc_id")
    # of several texts under one id the one of least hash
    one = found.groupBy("doc_id").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text"), F.first("quality").cast("int").alias("label"))
    rows = one.select("text", "label").mapInArrow(_vectors, "label int, x binary").toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float16).reshape(-1, _TERMS).astype(np.float32)
    y = np.array(rows["label"].to_pylist(), np.float32)
    del rows
    order = np.lexsort(np.column_stack([x[:, ::97], y]).T) if len(y) else np.arange(0)  # the order rows come in must not matter
    x = x[order]  # one copy at a time in the driver's memory
    return Voter(x, y[order])


def score(docs: DataFrame, voter: Voter, threshold: float = 0.7, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted (1 from `threshold` on), under the names of `out`, which replace columns of these names. Each row by its whole text; null and empty texts and texts of white space score 0."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(voter)
    docs = docs.drop(*out)
    at = docs.columns.index("text")
    schema = docs.withColumns({out[0]: F.lit(0.0), out[1]: F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode() for t in b.column(at).to_pylist()]
            scores: list[float] = []
            start = 0
            while start < len(raw):
                end, size = start, 0
                while end < len(raw) and (end == start or size + len(raw[end]) + 4 * _TERMS <= _BYTES):
                    size += len(raw[end]) + 4 * _TERMS
                    end += 1
                scores += sent.value.vote(terms(raw[start:end])).tolist()
                start = end
            s = np.array(scores)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, *out])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; repeated rows each give one."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
