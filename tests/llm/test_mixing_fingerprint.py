import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from namesift.llm import fingerprint, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n, seed=1, sources=("a", "b", "c", "d", None)):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 60))), "en", sources[0] if rnd.random() < 0.4 else rnd.choice(sources), 0) for i in range(n)]


def shares(sizes):
    """The targets by repeated sharing, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, total = {}, set(names), float(sum(sizes.values()))
    while left:
        level = total / sum(w[s] for s in left)
        over = {s for s in left if w[s] * level >= 3 * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in left}
        for s in over:
            out[s] = 3.0 * sizes[s]
            total -= out[s]
        left -= over
    return out


def test_targets_and_taken(spark):
    data = rows(600) + [(1000, None, "en", "a", 0), (1001, "", "en", "b", 0), (1002, "w " * 3000, "en", "b", 0), (5, "dup row", "en", "c", 0), (5, "dup row", "en", "c", 0)]
    docs = spark.createDataFrame(data, DOCS)
    got = mixing.report(docs).collect()
    assert len(got) == len(data)
    sizes = defaultdict(int)
    for _, t, _, s, _ in data:
        sizes[s] += len((t or "").split())
    want, taken, largest = shares(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken in {r.size * k for k in range(4)}
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixing.report(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("[^ ]+"))).alias("w")).collect()
    assert {r.source: r.w for r in words} == {s: w for s, w in taken.items() if w}


def test_tree_levels_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    data = rows(500, 3)
    got = mixing.report(spark.createDataFrame(data, DOCS)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    for s, t in shares(sizes).items():
        assert abs(taken[s] - t) <= 60


def test_mixing_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mixing.report(docs).count() == 0 and mixing.mix(docs).count() == 0


def test_pivot_is_unbiased():
    n = 20_000
    kept = 0.0
    for i in range(n):
        a, b = {"doc_id": i, "h": 0, "size": 3, "rows": 1, "part": 0.4}, {"doc_id": i, "h": 1, "size": 2, "rows": 1, "part": 0.7}
        done, left = mixing.pivot(1, 0, a, b)
        assert abs(3 * a["part"] + 2 * b["part"] - 2.6) < 1e-9 and done
        kept += a["part"]
    assert abs(kept / n - 0.4) < 0.01


def brute(data):
    order = sorted(((i, t or "") for i, t, *_ in data), key=lambda x: -x[0])
    out = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        e = t[: len(t) - cut] + nxt[:cut] if cut else t
        out[i] = len(t), hashlib.sha256(e.encode()).hexdigest(), e, nxt
    return out


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 20)
    data = [(i, " ".join(f"w{random.Random(i * 1000 + j).randint(0, 10**6)}é" for j in range(i % 90)), "en", "a", 0) for i in range(200)] + [(300, None, "en", "a", 0), (301, "xy", "en", "a", 0), (302, "z " * 50_000, "en", "a", 0)]
    got = {r.doc_id: r for r in fingerprint.compare_neighbours(spark.createDataFrame(data, DOCS)).collect()}
    want = brute(data)
    assert len(got) == len(data)
    near = []
    for i, (n, sha, e, nxt) in want.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        sk = fingerprint.sketches([e.encode(), nxt.encode()])
        assert r.edited_fingerprint == fingerprint.text_of(sk[0])
        assert r.near_next == fingerprint.containment(fingerprint.of_text(r.fingerprint), sk[1])
        assert 0 <= r.near_edited <= 1
        if n > 400:
            near.append(r.near_edited)
            assert r.near_next < 0.3
    assert 0.5 < sum(near) / len(near) < 0.8
    assert got[300].fingerprint == "" and got[301].near_edited == 1.0


def test_equal_texts_and_merge(spark):
    t = [b"one two three four five six seven eight nine ten", b"eleven twelve thirteen fourteen fifteen sixteen", b"only", b" \n "]
    a, b, c, d = fingerprint.sketches(t)
    assert d.size == 0 and c.size == 1
    assert (fingerprint.sketches([t[1], t[0]])[1] == a).all()
    long = [("w%d " % i * 1).encode() for i in range(4000)]
    x, y = b" ".join(long[:3000]), b" ".join(long[2000:])
    p, q = fingerprint.sketches([x, y])
    assert abs(fingerprint.containment(p, q) - 1 / 3) < 0.06
    assert set(fingerprint.of_text(fingerprint.merge(fingerprint.text_of(p), fingerprint.text_of(q)))) == set(p) | set(q)


def test_odd_tables(spark):
    assert fingerprint.compare_neighbours(spark.createDataFrame([], DOCS)).count() == 0
    one = fingerprint.compare_neighbours(spark.createDataFrame([(1, "a b c d e f", "", "", 6)], DOCS)).collect()
    assert one[0].near_next == 1.0
    odd = spark.createDataFrame([(None, "null id", "", "", 0), (4, "same", "", "", 0), (4, "same", "", "", 0)], DOCS)
    assert fingerprint.compare_neighbours(odd).count() == 3
