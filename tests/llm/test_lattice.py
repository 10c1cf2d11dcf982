import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from namesift.llm import lattice
from namesift.llm.queries import OP12_SQL

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, least=0.9):
    dims = max((len(v) for _, v in rows if v is not None), default=1)
    u = np.zeros((len(rows), dims))
    for i, (_, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            u[i, : len(v)] = v
    n = np.abs(u).max(1)
    u[n > 0] /= n[n > 0][:, None]
    u[n > 0] /= np.linalg.norm(u[n > 0], axis=1)[:, None]
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    part = list(range(len(rows)))

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, j in zip(*np.nonzero(near), strict=True):
        part[top(i)] = top(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[top(i)] = min(low.get(top(i), k), k)
    return ordered((k, int(near[i].sum()), low.get(top(i)), k == low.get(top(i))) for i, (k, _) in enumerate(rows))


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def groups(rng, dims=64):
    """Lone vectors, copies, near copies of several tightness and a chain whose ends are not alike."""
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    out = list(unit(rng.normal(size=(300, dims))))
    for size, spread in ((2, 0.1), (5, 0.2), (40, 0.15), (300, 0.02)):
        centre = unit(rng.normal(size=dims))
        out += list(unit(centre + spread * unit(rng.normal(size=(size, dims)))))
    a, b = np.eye(dims)[:2]
    out += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 2, 0.35)]
    out += [out[0]] * 30 + [2 * out[1], -out[2]]
    return [[float(np.float32(x)) for x in v] for v in out]


@pytest.mark.parametrize("rows_of_cell", [2048, 16])
def test_against_all_pairs(spark, monkeypatch, rows_of_cell):
    monkeypatch.setattr(lattice, "CELL_ROWS", rows_of_cell)
    vectors = groups(np.random.default_rng(6))
    rows = [(7 * i % 1009, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumns({c: F.lit(1) for c in ("cid", "dir", "n", "vec", "cell", "kept")})
    assert ordered(lattice.near_duplicates(df).collect()) == brute(rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(8)
    v = [float(np.float32(x)) for x in rng.normal(size=8)]
    rows = [(5, v), (5, v), (4, [2 * x for x in v]), (None, v), (9, None), (10, [0.0] * 8), (11, [-0.0, 0.0]), (12, []), (13, [float("nan")] * 8), (14, [float("inf")] * 8), (15, [None] * 8), (16, [*v[:7], None]),
            (20, [1.0, 0.0, 0.0]), (21, [1.0, -0.0, 0.0, 0.0, 0.0]), (22, [1.0]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (30, [1e38, 1e-38]), (31, [1e-38, 0.0]), (9, None)]
    assert ordered(lattice.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()) == ordered((k, n, c, k == c) for k, n, c, _ in brute(rows))


def test_none(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in lattice.near_duplicates(spark.createDataFrame([(1, None)], SCHEMA)).collect()] == [(1, 0, 1, True)]


def test_recall_at_the_threshold():
    """Pairs of a cosine of just 0.9: 0.99 and more share a cell; of 0.95 nearly all."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    own = lattice.Lattice(64)
    cells = own.cells(x)
    for cos, least in ((0.9, 0.985), (0.95, 0.999)):
        y = own.cells(cos * x + np.sqrt(1 - cos * cos) * z)
        met = (cells[:, :, 0] == y[:, :, 0]) | (cells[:, :, :1] == y[:, :, 1:]).any(2) | (y[:, :, :1] == cells[:, :, 1:]).any(2)
        assert met.any(1).mean() >= least


def test_lattice_points():
    """Decoded points are of E8, and none of the 240 points around is nearer."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(2000, 8)) * 3
    p = lattice.nearest(x)
    whole = (p % 1 == 0).all(1) | (p % 1 == 0.5).all(1)
    assert whole.all() and (p.sum(1) % 2 == 0).all() and len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS**2).sum(1), 2)
    around = ((x[:, None] - p[:, None] - lattice.ROOTS) ** 2).sum(2).min(1)
    assert (((x - p) ** 2).sum(1) <= around + 1e-9).all()


def test_sql_says_the_same(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate(groups(np.random.default_rng(11))) if i % 3 == 0 or i > 600] + [(5000, None), (5001, [0.0] * 64), (5002, [None] * 64)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/e")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert ordered(lattice.near_duplicates(df).collect()) == ordered(duck.execute(OP12_SQL).fetchall())
