from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesift.llm import whitening
from namesift.llm.common import table

SF = "/root/testdata/sf0.001"


def exact(rows):
    """n, sums and the covariance by fractions, from rows of entries."""
    n, dims = len(rows), len(rows[0])
    sums = [sum(r[k] for r in rows) for k in range(dims)]
    d = [[n * x - s for x, s in zip(r, sums, strict=True)] for r in rows]
    cov = [[float(Fraction(sum(r[i] * r[j] for r in d), n**3)) for j in range(dims)] for i in range(dims)]
    return n, sums, d, np.array(cov)


def check(got, rows, ids, most=32):
    n, sums, d, cov = exact(rows)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    alive = values > values[0] * 1e-12
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == set(ids) and len(got) == len(rows) * len(values)
    y = np.array([[r.whitened for r in sorted(by[i], key=lambda r: r.component)] for i in ids], dtype=float)
    want = (np.array([[float(Fraction(x, n)) for x in r] for r in d]) @ axes) / np.sqrt(np.where(alive, values, 1))
    sign = np.sign((y * want).sum(0))
    assert np.allclose(y[:, alive], (want * sign)[:, alive], rtol=1e-7, atol=1e-7) and np.isnan(y[:, ~alive]).all()
    for i, r in zip(ids, d, strict=True):
        for x in by[i]:
            assert x.n == n and x.deviation == sum(v * v for v in r)
            assert x.explained == pytest.approx(values[x.component - 1] / np.trace(cov), rel=1e-9, abs=1e-12)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    z = y[:, alive] - y[:, alive].mean(0)
    assert np.abs(z.T @ z / n - np.eye(alive.sum())).max() < 1e-9


def of(v):
    return [int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v]


def test_against_fractions(spark):
    e = table(spark, SF, "embeddings").limit(120).collect()
    df = spark.createDataFrame([(r.vec_id, r.embedding) for r in e], "vec_id long, embedding array<float>").repartition(5)
    check(whitening.whiten(df).collect(), [of(r.embedding) for r in e], [r.vec_id for r in e])


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=6) * (50, 9, 3, 1, 1, 1)]) for i in range(80)]
    good += [(80, good[0][1]), (81, good[0][1]), (82, good[1][1][:3])]
    bad = [(90, None), (91, [None] * 6), (92, [float("nan")] * 6), (93, [1.0] * 5 + [float("inf")]), (94, [1.0, None, 2.0, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumns({c: F.lit(7) for c in ("x", "n", "component", "whitened")})
    rows = [of([*v, *[0.0] * (6 - len(v))]) for _, v in good]
    check(whitening.whiten(df).collect(), rows, [i for i, _ in good])


def test_without_variance(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0, 3.0]) for i in range(4)] + [(None, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert len(got) == 15 and all((r.whitened is None) == (r.component > 1) for r in got) and {r.identity_error for r in got if r.identity_error > 1e-12} == set()
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>")).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.n == 3 for r in same)


def test_none(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []


def test_sums_that_doubles_lose(spark):
    """A covariance whose terms cancel to a part in 10 ** 20 of their size."""
    rng = np.random.default_rng(5)
    x = rng.integers(-1000, 1000, (400, 3)) + 10**12
    i, j = np.triu_indices(3)
    mean = whitening.mean_pair([int(s) for s in x.sum(0)], len(x))
    acc = np.zeros((1, 2, len(i)))
    for r in x:
        d, e = whitening.centred(r[None], *mean)
        acc[:, 0], acc[:, 1] = whitening.add_outer(acc[:, 0], acc[:, 1], d, e, i, j)
    _, _, _, cov = exact(x.tolist())
    assert np.allclose((acc[0, 0] + acc[0, 1]) / len(x), cov[i, j], rtol=1e-15, atol=0)
    big = np.array([[[1e300], [0.0]], [[1.0], [1e-20]], [[-1e300], [0.0]], [[2.0], [0.0]]])
    assert whitening.merge(big[[1, 3]])[0] == 3.0 and whitening.merge(np.array([[[1.0], [1e-20]], [[-1.0], [0.0]]]))[0] == 1e-20


def test_parts_are_merged_in_groups(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGED", 3)
    e = table(spark, SF, "embeddings").limit(60).collect()
    df = spark.createDataFrame([(r.vec_id, r.embedding[:5]) for r in e], "vec_id long, embedding array<float>").repartition(20)
    check(whitening.whiten(df, most=3).collect(), [of(r.embedding[:5]) for r in e], [r.vec_id for r in e], 3)


def test_deviations_beyond_a_long():
    assert whitening.deviations(np.array([[1 << 40], [0]]), [1 << 40], 2) == [None, None]
    assert whitening.deviations(np.array([[3], [1]]), [4], 2) == [4, 4]
