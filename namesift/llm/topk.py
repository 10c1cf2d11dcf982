"""Exact top-k inner-product search by columnar branch-and-bound.

Candidates lie dimension-major. Each query takes its dimensions in the order of their weight, a block at a time; after
each block Cauchy-Schwarz on the remaining mass of both sides bounds what a candidate can still reach, and candidates
that can no longer enter this query's list are compacted away before its next block. The threshold comes from earlier
candidates, from what others reach at least, and from the whole scores of the few that are ahead after some blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTIAL = "query_id long, vec_id long, score long"
BLOCK_DIMS = 8
#: The range of a score; what lies beyond counts as its end.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Candidates whose partial scores are held at once.
CANDIDATE_ROWS = 4096
#: Candidates are compacted once so many of a chunk are still in the race at most.
COMPACT = 0.97
#: After so many dimensions the whole scores of so many candidates a place in the list are taken ahead.
PROBE_DIMS, PROBES = 16, 3


def quantise(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, vec) with floor(scale * x) components. Null ids and vectors that are null, or hold null or non-finite components, take no part."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    ints = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("vec"))


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """One int64 row for each vector; shorter vectors count as padded with zeros, components past dims meet zeros."""
    flat, ends = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    lens = np.diff(ends)
    if lens.size and (lens == dims).all():
        return flat[ends[0] : ends[-1]].reshape(-1, dims)
    out = np.zeros((lens.size, dims), np.int64)
    for i, (a, n) in enumerate(zip(ends[:-1], np.minimum(lens, dims), strict=True)):
        out[i, :n] = flat[a : a + n]
    return out


class Query:
    """A query vector with its dimensions in the order of their weight, and the mass that is left after each block."""

    def __init__(self, q: np.ndarray):
        self.exact = q
        self.plain = plain(q[None])[0]
        w = np.abs(q.astype(float))
        self.order = np.argsort(-w, kind="stable")
        self.q = q[self.order].astype(float)
        self.rest = np.append(np.sqrt(np.cumsum(np.square(self.q)[::-1]))[::-1], 0.0)


def plain(x: np.ndarray) -> np.ndarray:
    """Rows whose products with each other a double adds without rounding."""
    dims = max(x.shape[1], 1)
    return (x <= math.isqrt(2**52 // dims)).all(1) & (x >= -math.isqrt(2**52 // dims)).all(1)


class Chunk:
    """Candidates dimension-major; those beyond exact doubles apart, as whole integers, for they alone need them."""

    def __init__(self, c: np.ndarray):
        ok = plain(c)
        self.rows, self.large = np.flatnonzero(ok), np.flatnonzero(~ok)
        self.all, self.columns = c, np.ascontiguousarray(c[ok].T, float)
        self.mass = np.square(self.columns).sum(0)
        self.products = 0

    def _whole(self, query: Query, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.all[rows].astype(object) @ query.exact.astype(object), LEAST, MOST).astype(np.int64)

    def best(self, query: Query, tau: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of every candidate that can reach the query's k best, tau being a score that k earlier ones reach."""
        if not query.plain:
            rows = np.arange(len(self.all))
            return rows, self._whole(query, rows)
        rows, part, mass, c = self.rows, np.zeros(len(self.rows)), self.mass, self.columns
        dims = len(query.q)
        for at in range(0, dims, BLOCK_DIMS):
            own = c[query.order[at : at + BLOCK_DIMS]]
            part = part + query.q[at : at + BLOCK_DIMS] @ own
            self.products += own.size
            end = at + BLOCK_DIMS
            if end >= dims or not rows.size:
                break
            mass = mass - np.square(own).sum(0)
            rest = query.rest[end] * np.sqrt(np.maximum(mass, 0.0)) * (1 + 1e-9) + 1e-6
            if rows.size >= PROBES * k and end == PROBE_DIMS:
                # the whole scores of the most promising ones are a threshold that many others cannot reach
                ahead = np.argpartition(-part, PROBES * k - 1)[: PROBES * k]
                after = query.order[end:]
                whole = part[ahead] + query.q[end:] @ self.columns[after][:, np.searchsorted(self.rows, rows[ahead])]
                self.products += whole.size * after.size
                tau = max(tau, float(np.partition(whole, whole.size - k)[whole.size - k]))
            elif rows.size >= k:
                tau = max(tau, float(np.partition(part - rest, rows.size - k)[rows.size - k]))
            alive = np.flatnonzero(part + rest >= tau)
            if alive.size < COMPACT * rows.size:
                rows, part, mass, c = rows[alive], part[alive], mass[alive], c[:, alive]
        kept = np.flatnonzero(part >= tau)
        rows, scores = rows[kept], part[kept].astype(np.int64)
        if self.large.size:
            rows, scores = np.concatenate([rows, self.large]), np.concatenate([scores, self._whole(query, self.large)])
        return rows, scores


class Search:
    """The k best of each query so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, [Query(q) for q in queries], k
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        self.products = 0

    def meet(self, c_ids: np.ndarray, c: np.ndarray) -> None:
        chunk, k = Chunk(c), self.k
        for i, query in enumerate(self.queries):
            had_ids, had = self.best[i]
            rows, scores = chunk.best(query, float(had[-1]) if len(had) == k else -math.inf, k + 1)
            other = c_ids[rows] != self.ids[i]
            if not other.any():
                continue
            all_ids, every = np.concatenate([had_ids, c_ids[rows][other]]), np.concatenate([had, scores[other]])
            # by falling score without its sign changed, which the least long does not have
            top = np.lexsort((all_ids, np.invert(every)))[:k]
            self.best[i] = all_ids[top], every[top]
        self.products += chunk.products


def _search(ids: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held, rows = Search(ids, queries, k), [], 0

        def meet(t: pa.Table) -> None:
            search.meet(t["vec_id"].to_numpy(), _matrix(pa.concat_arrays(t["vec"].chunks), queries.shape[1]))

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= CANDIDATE_ROWS:
                meet(pa.concat_tables(held))
                held, rows = [], 0
        if rows:
            meet(pa.concat_tables(held))
        n = [len(x) for x, _ in search.best]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), *(pa.array(np.concatenate([x[j] for x in search.best])) for j in (0, 1))], ["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, block: int = 32_768) -> DataFrame:
    """The k highest inner products of each query vector among the candidate vectors, ties to the smaller vec_id.

    queries, candidates: (vec_id long, vec array<long>), as quantise() gives. A candidate with the query's own
    vec_id is not counted. Queries go out in blocks of at most about `block` vectors, one scan of the candidates
    for each block, so that a broadcast never grows with the data. Each task sends at most k rows a query.
    A query row that repeats wholly counts once, of unlike vectors under one query id the least asks (entry by entry);
    repeated candidate rows each take a rank. Empty tables give no rows.
    Vectors of unequal length meet as if padded with zeros. Components and scores beyond a long count as its ends,
    so that such scores tie. Returns query_id, rank (from 1), vec_id, score.
    """
    spark = queries.sparkSession
    q = queries.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    n, dims = q.agg(F.count("*"), F.max(F.size("vec"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n or not dims:
        return spark.createDataFrame([], schema)
    blocks, parts = math.ceil(n / block), []
    for b in range(blocks):
        own = q if blocks == 1 else q.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        t = own.toArrow()
        if t.num_rows:
            ids = t["vec_id"].to_numpy()
            order = np.argsort(ids)
            sent = spark.sparkContext.broadcast((ids[order], _matrix(pa.concat_arrays(t["vec"].chunks), dims)[order]))

            def run(batches, sent=sent):
                yield from _search(*sent.value, k)(batches)

            parts.append(candidates.mapInArrow(run, PARTIAL))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
