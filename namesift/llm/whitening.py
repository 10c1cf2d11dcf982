"""Embedding whitening: exact sums, a compensated covariance, its eigenvectors, whitened components.

Sums of the integer entries are exact. The covariance is gathered from outer products of centred vectors in
double-double: the mean, the differences and the running sums are pairs of doubles, products and sums go through
error-free transformations, so nothing is lost that 100 bits can hold. Each task gives one pair of high and low parts
a batch, pairs are merged in groups of tasks until few are left, and the matrix of one row and column a dimension goes
to the driver. The symmetric matrix is brought to tridiagonal form and solved by divide and conquer (LAPACK's syevd).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesift.llm.common import materialise

#: Running sums that a batch is dealt out to; they are merged at its end.
LANES = 16
#: Pairs of parts that one task merges.
MERGED = 64
#: Bits of the low half of a long in partial sums.
HALF = 26
#: Ends of an entry, so that it is exact as a double.
END = 1 << 52
_SPLIT = float((1 << 27) + 1)


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and what rounding took."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a as the sum of two numbers of 26 bits."""
    c = _SPLIT * a
    high = c - (c - a)
    return high, a - high


def add(high: np.ndarray, low: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (high, low) + (x, y)."""
    s, e = two_sum(high, x)
    t, f = two_sum(low, y)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def add_outer(high: np.ndarray, low: np.ndarray, d: np.ndarray, e: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) plus the products of columns i and j of the pairs (d, e), row by row."""
    a, b = d[:, i], d[:, j]
    h, t = halves(d)
    p = a * b
    err = ((h[:, i] * h[:, j] - p) + h[:, i] * t[:, j] + t[:, i] * h[:, j]) + t[:, i] * t[:, j]
    return add(high, low, p, err + (a * e[:, j] + e[:, i] * b))


def merge(parts: np.ndarray) -> np.ndarray:
    """The sum of pairs: (n, 2, size) to (2, size)."""
    while len(parts) > 1:
        k = len(parts) // 2
        high, low = add(parts[:k, 0], parts[:k, 1], parts[k : 2 * k, 0], parts[k : 2 * k, 1])
        parts = np.concatenate([np.stack([high, low], 1), parts[2 * k :]])
    return parts[0]


def _pairs(dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(dims)


def _dense(col: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of longs, shorter ones filled up with the entry of 0."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.diff(a.offsets.to_numpy())
    flat = a.flatten().to_numpy(zero_copy_only=False)
    out = np.full((len(a), dims), 1_000_000, np.int64)
    out[np.arange(dims) < n[:, None]] = flat
    return out


def entries(vector: str = "embedding") -> Column:
    """floor(64 * c) + 1000000 of each entry; null for a vector that is null or holds null or non-finite entries."""
    c = F.col(vector)
    known = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.greatest(F.lit(-float(END)), F.least(F.lit(float(END)), F.floor(64.0 * x.cast("double")).cast("double"))).cast("long") + 1_000_000
    return F.when(c.isNotNull() & known, F.transform(c, whole))


def _sums(x: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows and the exact sum of each dimension: halves of longs are added up in each task, then as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _dense(b.column(0), dims)
            if len(m):  # at most 2 ** 16 rows of 2 ** 53 and less: halves of 26 and 28 bits cannot run over
                yield pa.RecordBatch.from_pydict({"n": [len(m)], "high": [(m >> HALF).sum(0).tolist()], "low": [(m & ((1 << HALF) - 1)).sum(0).tolist()]}, schema=pa.schema([("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]))

    parts = x.select("x").mapInArrow(run, "n long, high array<long>, low array<long>")
    rows = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("dim", "s")).groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("s.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("s.low").cast("decimal(38,0)")).alias("low")
    ).orderBy("dim").collect()  # one row a dimension
    return rows[0].n, [(int(r.high) << HALF) + int(r.low) for r in rows]


def _merged(parts: DataFrame, size: int, name: str) -> np.ndarray:
    """The sum of all tasks' pairs (high, low), merged in groups of MERGED until so many are left at most."""
    parts = materialise(parts.select(F.monotonically_increasing_id().alias("no"), "high", "low"), name)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = merge(np.stack([np.stack([np.frombuffer(h), np.frombuffer(w)]) for h, w in zip(pdf.high, pdf.low, strict=True)]))
        return pd.DataFrame({"no": [key[0]], "high": [x[0].tobytes()], "low": [x[1].tobytes()]})

    while (n := parts.count()) > MERGED:
        groups = F.pmod(F.xxhash64("no"), F.lit(-(-n // MERGED))).alias("no")
        parts = materialise(parts.withColumn("no", groups).groupBy("no").applyInPandas(run, "no long, high binary, low binary"), name)
    found = [np.stack([np.frombuffer(bytes(r.high)), np.frombuffer(bytes(r.low))]) for r in parts.orderBy("no").collect()]
    return merge(np.stack(found)) if found else np.zeros((2, size))


def _gather(x: DataFrame, dims: int, values: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, outer: bool, name: str) -> np.ndarray:
    """The sum in double-double over all rows of values(row), pairs of `size` columns, or of their outer products (upper triangle)."""
    i, j = _pairs(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, rows = np.zeros((LANES, 2, len(i) if outer else size)), 0
        for b in batches:
            d, e = values(_dense(b.column(0), dims))
            rows += len(d)
            for at in range(0, len(d), LANES):
                own, low = d[at : at + LANES], e[at : at + LANES]
                k = len(own)
                high, rest = add_outer(acc[:k, 0], acc[:k, 1], own, low, i, j) if outer else add(acc[:k, 0], acc[:k, 1], own, low)
                acc[:k, 0], acc[:k, 1] = high, rest
        if rows:
            total = merge(acc)
            yield pa.RecordBatch.from_pydict({"high": [total[0].tobytes()], "low": [total[1].tobytes()]}, schema=pa.schema([("high", pa.binary()), ("low", pa.binary())]))

    return _merged(x.select("x").mapInArrow(run, "high binary, low binary"), len(i) if outer else size, name)


def mean_pair(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """sums / n as pairs of doubles, each rounded from the exact quotient."""
    from fractions import Fraction

    high = np.array([float(Fraction(s, n)) for s in sums])
    low = np.array([float(Fraction(s, n) - Fraction(h)) for s, h in zip(sums, high.tolist(), strict=True)])
    return high, low


def centred(x: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x less the pair (high, low), as a pair."""
    s, e = two_sum(x.astype(np.float64), -high)
    return two_sum(s, e - low)


def _symmetric(pair: np.ndarray, size: int, n: int) -> np.ndarray:
    i, j = _pairs(size)
    out = np.zeros((size, size))
    out[i, j] = out[j, i] = (pair[0] + pair[1]) / n
    return out


def _deviation(row: list[int], sums: list[int], n: int) -> int | None:
    d = sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True))
    return d if d < 1 << 63 else None


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """The exact sum over dimensions of (n * x - S) ** 2; null beyond a long."""
    far = max(max(abs(n * int(v) - s) for v, s in zip(edge, sums, strict=True)) for edge in (x.min(0), x.max(0))) if len(x) else 0
    if far * far * x.shape[1] < 1 << 63 and max(map(abs, sums), default=0) < 1 << 62:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    return [_deviation(r, sums, n) for r in x.tolist()]


def whiten(vectors: DataFrame, most: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each vector and component.

    Vectors that are null or hold null or non-finite entries are dropped. An entry c counts as floor(64 * c) + 1000000.
    The fit list is all remaining rows, repeated ones and those without an id included. Vectors of unequal length meet
    as if filled up with c = 0. Entries beyond 2 ** 52 count as that end, a deviation beyond a long is null. Components
    are numbered by falling variance, at most `most` and no more than there are dimensions; their sign makes the
    largest entry positive. One without variance (equal vectors, fewer vectors than components) has explained 0 and a
    null whitened, and plays no part in identity_error, the largest absolute entry of the whitened values' covariance
    less the identity. No vectors left, or none with entries, give no rows.
    """
    spark = vectors.sparkSession
    schema = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = vectors.select(F.col(key).cast("long").alias(key), entries(vector).alias("x")).where("x is not null")
    dims = x.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return spark.createDataFrame([], schema)
    n, sums = _sums(x, dims)
    mean = mean_pair(sums, n)
    cov = _symmetric(_gather(x, dims, lambda m: centred(m, *mean), dims, True, "covariance"), dims, n)
    trace = float(np.trace(cov))
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    size = len(values)
    alive = values > max(values[0], 0.0) * 1e-12
    values = np.where(alive, values, 0.0)
    scale = np.where(alive, 1 / np.sqrt(np.where(alive, values, 1.0)), 0.0)

    def project(m: np.ndarray) -> np.ndarray:
        d, e = centred(m, *mean)
        return (d @ axes + e @ axes) * scale

    zero = lambda y: (y, np.zeros_like(y))
    total = _gather(x, dims, lambda m: zero(project(m)), size, False, "whitened-sums") / n
    again = _symmetric(_gather(x, dims, lambda m: centred(project(m), total[0], total[1]), size, True, "whitened-covariance"), size, n)
    error = float(np.abs(again - np.eye(size))[np.ix_(alive, alive)].max()) if alive.any() else 0.0
    explained = values / trace if trace > 0 else np.zeros(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                m = _dense(part.column(1), dims)
                k = len(m)
                y = pa.array(project(m).ravel(), mask=np.tile(~alive, k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(k), size))), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), k)), pa.array(np.full(k * size, n, np.int64)),
                        pa.array(deviations(m, sums, n), pa.int64()).take(pa.array(np.repeat(np.arange(k), size))), y, pa.array(np.tile(explained, k)), pa.array(np.full(k * size, error)),
                    ],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.mapInArrow(run, schema)
