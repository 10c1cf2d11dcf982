import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from namesift.llm import blocks, ctw, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def remainder(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in (t or ""))


def unigrams(data):
    train = [low(t).encode().split() for i, t in data if remainder(i, 7) != 2]
    c = Counter(w for d in train for w in d)
    ends = len(train)
    n, v = sum(c.values()) + ends, len(c) + bool(ends)
    out = []
    for i, t in data:
        w = low(t).encode().split()
        s = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        out.append((i, remainder(i, 7) == 2, len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), n, s))
    return out


def weighted(data):
    """log10 probabilities by the recursion itself, node by node."""
    counts = Counter()
    for i, t in data:
        if remainder(i, 7) != 2:
            s = b"\0\0" + low(t).encode() + b"\0"
            for k in range(2, len(s)):
                node = 1
                for bit in range(7, -1, -1):
                    b = s[k] >> bit & 1
                    for d in range(3):
                        counts[d, s[k - d : k], node, b] += 1
                    node = 2 * node + b
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    n = lambda d, c, node: (counts[d, c, node, 0], counts[d, c, node, 1])
    longer = {}
    for d, c, node, _ in list(counts):
        if d:
            longer.setdefault((d - 1, c[1:], node), set()).add(c)
    memo = {}

    def log_w(d, c, node):
        if (d, c, node) not in memo:
            e = kt(*n(d, c, node))
            memo[d, c, node] = e if d == 2 else np.logaddexp(e, children(d, c, node)) - math.log(2)
        return memo[d, c, node]

    def children(d, c, node):
        return sum(log_w(d + 1, x, node) for x in longer.get((d, c, node), ()))

    def one(d, c, full, node):
        a, b = n(d, c, node)
        own = (b + 0.5) / (a + b + 1)
        if d == 2:
            return own
        beta = math.exp(min(700, max(-700, kt(a, b) - children(d, c, node))))
        return (beta * own + one(d + 1, full[len(full) - d - 1 :], full, node)) / (beta + 1)

    out = {}
    for i, t in data:
        s, total = b"\0\0" + low(t).encode() + b"\0", 0.0
        for k in range(2, len(s)):
            node = 1
            for bit in range(7, -1, -1):
                b, p = s[k] >> bit & 1, one(0, b"", s[k - 2 : k], node)
                total += math.log10(p if b else 1 - p)
                node = 2 * node + b
        out[i] = total
    return out


def some(n, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(["the", "of", "Thé", "andX", "zu", f"w{rnd.randrange(40)}"]) for _ in range(rnd.randint(0, 12)))) for i in range(n)] + [(500, None), (501, ""), (502, "\n the\tof \r"), (None, "the of")]


@pytest.mark.parametrize("block", [4 << 20, 40])
def test_language_model(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)  # workers fork from this process only once, so the driver's size counts where they do
    data = some(60)
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in data], DOCS)
    got = ctw.score(docs).collect()
    want, model = unigrams(data), weighted(data)
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    for i, held, n, known, total, base in want:
        r = by[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-9 and abs(r.score - model[i]) < 1e-3


def test_language_model_odd_tables(spark):
    assert ctw.score(spark.createDataFrame([], DOCS)).count() == 0
    i = next(k for k in range(100) if remainder(k, 7) == 2)
    r = ctw.score(spark.createDataFrame([(i, "ab", "", "", 0), (i, "ab", "", "", 0)], DOCS)).collect()
    assert len(r) == 2 and r[0].train_tokens == 0 and r[0].base_score == 0 and abs(r[0].score - 24 * math.log10(0.5)) < 1e-4


def test_predictions_are_distributions(spark):
    table = ctw.predictions(spark.createDataFrame([(97, ctw._pack(np.array([98 * 256 + 99, 99], np.uint16)), ctw._pack(np.array([5, 2], np.int64)))], "part int, a binary, b binary").groupBy("part").applyInPandas(ctw._subtree, "part int, p binary, w binary").collect())
    t = 10.0 ** table.reshape(256, 256, 256).astype(float)
    assert np.abs(t[[97, 97, 5]][:, [98, 3, 7]].sum(-1) - 1).max() < 1e-4 and t[97, 98, 99] > 0.5


def test_words_of_blocks():
    rnd = random.Random(4)
    raw = ["".join(rnd.choice("aAbé \n\t\x0b\x1f") for _ in range(rnd.randint(0, 40))).encode() for _ in range(300)]
    w = blocks.words(raw, True)
    lists = [[x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x.decode()).encode() for x in r.split()] for r in raw]
    assert w.text.tolist() == [i for i, x in enumerate(lists) for _ in x]
    names = [x for r in lists for x in r]
    assert len(set(zip(names, w.hashes.tolist(), strict=True))) == len(set(names)) == len(set(w.hashes.tolist()))


def good(rnd):
    return " ".join("".join(rnd.choice(["th", "an", "er", "on", "re"]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(20, 120))) + "."


def bad(rnd):
    t = good(rnd)
    return rnd.choice([t.upper().replace(" ", "!! "), t.replace(" ", "%%% "), t.replace(" ", " | "), " ".join([t[:60]] * 12)])


def test_quality(spark):
    rnd = random.Random(5)
    data = [(i, good(rnd) if i % 3 else bad(rnd), int(i % 3 > 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t, _ in data] + [(2000, None, "", "", 0), (2001, "", "", "", 0), (2002, " \n", "", "", 0), (2003, good(rnd) * 300, "", "", 0), (None, good(rnd), "", "", 0)], DOCS)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data if i < 700] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 905 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) for r in got.values())
    held = [(q, got[i].predicted) for i, _, q in data if remainder(i, 4) == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert got[2000].score == got[2001].score == got[2002].score == 0.0
    again = {r.doc_id: r.score for r in quality.classify(docs.repartition(5), labels.repartition(3)).collect()}
    assert all(abs(again[i] - r.score) < 1e-4 for i, r in got.items())
    # labels of the held-out remainder are never read
    wrong = labels.union(spark.createDataFrame([(i, 1 - q, 0) for i, _, q in data if remainder(i, 4) == 2 and i >= 700], labels.schema))
    assert {r.doc_id: r.score for r in quality.classify(docs, wrong).collect()} == {i: r.score for i, r in got.items()}


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c", "", "", 0)], DOCS)
    assert quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).first().score == 0.5
    assert quality.classify(docs.limit(0), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0


def test_vote_is_the_exact_cosine():
    rng = np.random.default_rng(6)
    x, y = rng.random((80, quality._TERMS), np.float32), rng.integers(0, 2, 80)
    v = quality.Voter(x, y, 8, 5, 2.0)
    z = rng.random((3, quality._TERMS), np.float32)
    for s, a in zip(v.vote(z), z @ v.project, strict=True):
        c = v.vectors @ (a / np.linalg.norm(a))
        at = np.argsort(-c)[:5]
        assert abs(s - (c[at] ** 2 * y[at]).sum() / (c[at] ** 2).sum()) < 1e-3


def test_lm_keeps_rows_of_null_and_large_ids(spark):
    """A null id beside ids past 2**53 changes none of them."""
    rows = [(None, "a b"), (2**60 + 1, "c d"), (2**60 + 3, "a c"), (-5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for depth in (2, 6):
        assert sorted((r.doc_id for r in ctw.score(docs, depth=depth).collect()), key=repr) == sorted((i for i, _ in rows), key=repr)
