import hashlib
import random

import numpy as np
import pytest

from namesift.llm import bpe, topk
from namesift.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


def brute(rows, k=10, scale=1024):
    ok = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 100:
            continue
        s = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q))[:k]
        out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("block, clustered", [(32_768, False), (2, True)])
def test_topk(spark, monkeypatch, block, clustered):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 64)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(5, 40)) * (3 if clustered else 0)
    rows = [(i, [float(np.float32(x)) for x in centre[i % 5] + rng.normal(size=40)]) for i in range(900)]
    rows += [(900, rows[3][1]), (901, rows[3][1]), (902, None), (903, [None] * 40), (904, [float("nan")] * 40), (905, [float("inf")] * 40), (None, rows[0][1]), (1000, [0.0] * 40), (1100, rows[0][1][:10])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.quantise(df, "vec_id", "embedding", 1024)
    got = topk.top_k(v.where("vec_id % 100 = 0"), v, 10, block)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_topk_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    v = topk.quantise(df, "vec_id", "embedding", 1024)
    assert [tuple(r) for r in topk.top_k(v.where("vec_id = 0"), v).collect()] == [(0, 1, 1, 2097152)]
    assert topk.top_k(v.limit(0), v).count() == 0


def test_topk_beyond_doubles():
    query, chunk = topk.Query(np.array([2**31, 3])), topk.Chunk(np.array([[2**31, 1], [2**31, 2], [5, 1]]))
    rows, scores = chunk.best(query, -np.inf, 1)
    assert dict(zip(rows.tolist(), scores.tolist(), strict=True)) == {0: 2**62 + 3, 1: 2**62 + 6, 2: 5 * 2**31 + 3}
    rows, scores = chunk.best(topk.Query(np.array([1, 1])), -np.inf, 3)
    assert dict(zip(rows.tolist(), scores.tolist(), strict=True)) == {0: 2**31 + 1, 1: 2**31 + 2, 2: 6}


def found(vectors, queries, sizes, k=10):
    search, at = topk.Search(queries, vectors[queries], k), 0
    for n in sizes:
        search.meet(np.arange(at, min(at + n, len(vectors))), vectors[at : at + n])
        at += n
    return search


def of_tables(sf):
    pq = pytest.importorskip("pyarrow.parquet")
    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet").sort_by("vec_id")
    return np.floor(1024 * np.array(t["embedding"].to_pylist(), dtype=np.float64)).astype(np.int64)


def test_bounds_skip_at_least_half_of_the_products():
    """On the 2000 vectors of sf0.1, in the one chunk that a task takes; the scores are those of the whole product."""
    v, ids = of_tables("sf0.1"), np.arange(0, 2000, 100)
    search = found(v, ids, [4096])
    whole = len(ids) * v.size
    assert search.products <= 0.5 * whole
    for i, (rows, scores) in zip(ids, search.best, strict=True):
        s = v @ v[i]
        s[i] = -(1 << 60)
        want = sorted(zip((-s).tolist(), range(len(v)), strict=True))[:10]
        assert [(-a, b) for a, b in want] == list(zip(scores.tolist(), rows.tolist(), strict=True))


def test_one_extreme_vector_leaves_the_others_their_bounds():
    v, ids = of_tables("sf0.1"), np.arange(0, 2000, 100)
    plain = found(v, ids, [4096]).products
    w = v.copy()
    w[1999, 3] = 1 << 60
    search = found(w, ids, [4096])
    assert abs(search.products - plain) < 0.02 * plain
    for i, (rows, scores) in zip(ids, search.best, strict=True):
        s = [max(topk.LEAST, min(topk.MOST, int(x))) for x in w.astype(object) @ w[i].astype(object)]
        want = sorted((-x, j) for j, x in enumerate(s) if j != i)[:10]
        assert [(-a, b) for a, b in want] == list(zip(scores.tolist(), rows.tolist(), strict=True))


def test_topk_of_unlike_queries_under_one_id(spark):
    df = spark.createDataFrame([(0, [2.0, 0.0]), (0, [1.0, 5.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    v = topk.quantise(df, "vec_id", "embedding", 1)
    assert [tuple(r) for r in topk.top_k(v.where("vec_id = 0"), v).orderBy("rank").collect()] == [(0, 1, 2, 5), (0, 2, 1, 1)]


def texts():
    rnd = random.Random(2)
    out = ["", "a", " ", "don't we'll I'M", "x <|endoftext|><|endoftext|>  y\n\n z", "日本語 한국어   x", "١٢٣ ½ ² \x1c\x1d\x85b c​d\U0001f600", "a" * 3000, "ab" * 2000 + " " * 300 + "x", "é" * 50 + "\r\n\t"]
    out += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0, 0x300), rnd.randrange(0x300, 0xD800), rnd.randrange(0xE000, 0x20000)])) for _ in range(120)) for _ in range(120)]
    return out + ["".join(rnd.choice("abcdeABC  '\n0129!.") for _ in range(200)) for _ in range(200)]


def test_bpe_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 500)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 300)
    path = tokenizer_path()
    lib, codec = tokenizers.Tokenizer.from_file(path), bpe.Codec(path)
    given = texts()
    want = [e.ids for e in lib.encode_batch(given, add_special_tokens=False)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for t, ids, (n, a, b) in zip(given, want, codec.digests(given), strict=True):
        assert (n, a, b) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
        assert codec.encode(t).tolist() == ids and codec.decode(ids) == t
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate([*given, None])], "doc_id long, text string, token_ids long")
    out = bpe.decode(bpe.encode(df, path), path).collect()
    assert [r.token_ids for r in sorted(out, key=lambda r: r.doc_id)] == [*want, []]
    assert all(r.decoded == (r.text or "") for r in out)
    assert bpe.round_trip(df.limit(0), path).count() == 0 and bpe.round_trip(df, path).count() == len(given) + 1


def test_pairs_that_merging_leaves_apart():
    codec = bpe.Codec(tokenizer_path())
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3000, 4000), rng.integers(0, 3000, 4000)
    ok = codec.apart_under_merging(a, b)
    for x, y, o in zip(a, b, ok, strict=True):
        alone = codec.merge(codec.bytes[x]) == [x] and codec.merge(codec.bytes[y]) == [y]
        assert not alone or o == (codec.merge(codec.bytes[x] + codec.bytes[y]) == [x, y])


def test_scores_beyond_a_long(spark):
    """Huge finite components neither crash nor wrap: scores stop at the ends of a long and tie there."""
    data = [(0, [1e30, 0.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 1.0]), (4, [1e30, 1.0])]
    v = topk.quantise(spark.createDataFrame(data, "vec_id long, embedding array<double>"), "vec_id", "embedding", 1024)
    got = [(r.vec_id, r.score) for r in topk.top_k(v.where("vec_id = 0"), v, 4).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (4, 2**63 - 1), (3, 0), (2, -(2**63))]
