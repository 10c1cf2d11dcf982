import math
from collections import Counter

import numpy as np
import pytest

from namesift.llm import blocks, ctw, queries
from tests.llm.test_scores import DOCS, low, remainder, some


def weighted(data, depth):
    """log10 probabilities by the recursion itself, node by node, to contexts of `depth` bytes."""
    counts, longer, memo = Counter(), {}, {}
    bits = lambda t: [(s[: k + 1], s[k] >> b & 1, (256 | s[k]) >> (b + 1)) for s in [b"\0" * depth + low(t).encode() + b"\0"] for k in range(depth, len(s)) for b in range(7, -1, -1)]
    for i, t in data:
        if remainder(i, 7) != 2:
            for s, b, node in bits(t):
                for d in range(depth + 1):
                    counts[s[len(s) - 1 - d : -1], node, b] += 1
    for c, node, _ in list(counts):
        if c:
            longer.setdefault((c[1:], node), set()).add(c)

    def kt(c, node):
        a, b = counts[c, node, 0], counts[c, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def children(c, node):
        return sum(log_w(x, node) for x in longer.get((c, node), ()))

    def log_w(c, node):
        if (c, node) not in memo:
            memo[c, node] = kt(c, node) if len(c) == depth else np.logaddexp(kt(c, node), children(c, node)) - math.log(2)
        return memo[c, node]

    def one(full, d, node):
        c = full[len(full) - d :]
        a, b = counts[c, node, 0], counts[c, node, 1]
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        w = 1 / (1 + math.exp(min(700, max(-700, children(c, node) - kt(c, node)))))
        return w * own + (1 - w) * one(full, d + 1, node)

    return {i: sum(math.log10(p if b else 1 - p) for s, b, node in bits(t) for p in [one(s[:-1], 0, node)]) for i, t in data}


def odd():
    return [*some(50), (600, "the of zu\0\0 the of"), (601, "the of zu " * 30)]


@pytest.mark.parametrize("depth,block", [(3, 4 << 20), (6, 4 << 20), (7, 40)])
def test_deep_contexts(spark, monkeypatch, depth, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    data = odd()
    got = ctw.score(spark.createDataFrame([(i, t, "", "", 0) for i, t in data], DOCS), depth=depth).collect()
    want = weighted(data, depth)
    assert len(got) == len(data)
    for r in got:
        t = dict(data)[r.doc_id]
        assert abs(r.score - want[r.doc_id]) < 1e-3 and r.n_bytes == len((t or "").encode())


def test_pieces_of_long_texts(monkeypatch):
    """A text cut into pieces has the keys of the whole text."""
    from namesift.llm import deeptree

    raw = b"the of and " * 9
    cut = [raw[:31], raw[31:33], raw[33:]]
    before = [(b"\0" * 6 + raw[:at])[-6:] for at in (0, 31, 33)]
    whole, n = deeptree.keys_of([raw], [b"\0" * 6], [True], 6)
    parts, m = deeptree.keys_of(cut, before, [False, False, True], 6)
    assert whole.tolist() == parts.tolist() and n.sum() == m.sum() == len(raw) + 1


def test_query_has_deep_contexts(spark, tmp_path):
    """A passage that recurs is told from the same words in another order."""
    data = odd()
    spark.createDataFrame([(i, t, "", "", 0) for i, t in data], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got, want, flat = queries.op10_lm_score(spark, str(tmp_path)).collect(), weighted(data, 6), weighted(data, 2)
    assert all(abs(r.score - want[r.doc_id]) < 1e-3 for r in got)
    assert max(abs(want[i] - flat[i]) for i, _ in data) > 1


def test_empty(spark):
    assert ctw.score(spark.createDataFrame([], DOCS), depth=6).count() == 0
    i = next(k for k in range(100) if remainder(k, 7) == 2)
    r = ctw.score(spark.createDataFrame([(i, "ab", "", "", 0), (i, "ab", "", "", 0)], DOCS), depth=6).collect()
    assert len(r) == 2 and r[0].train_tokens == 0 and abs(r[0].score - 24 * math.log10(0.5)) < 1e-4


@pytest.mark.parametrize("times", [1, 30_000, 4_000_000])
def test_common_contexts_leave_room_for_others(times):
    """However often one byte followed another, the 256 bytes that may come next have probabilities that sum to one; none is missing."""
    import pandas as pd

    from namesift.llm import deeptree

    depth, context = 6, [b"ababab", b"xxabab", b"aba\0\0\0", b"qqqqqq"]
    seen, n = np.unique(deeptree.keys_of([b"ab" * 500], [b"\0" * depth], [True], depth)[0], return_counts=True)
    above = deeptree.keys_of([b"a"] * 4, context, [False] * 4, depth)[0] >> np.uint64(8) << np.uint64(8)
    asked = (above[:, None] | np.arange(256, dtype=np.uint64)).ravel()
    keys = np.unique(np.concatenate([seen, asked]))
    counts = np.zeros(keys.size, np.uint32)
    counts[np.searchsorted(keys, seen)] = n * times
    pdf = pd.DataFrame({"block": [0], "part": [0], "a": [deeptree.pack(keys)], "b": [deeptree.pack(counts)]})

    class Model:
        value = deeptree.upper([g.iloc[0] for _, g in deeptree.part_top(depth)(pdf).groupby("last") for g in [deeptree.last_byte(g)]])

    score = deeptree.unpack(deeptree.part_scores(depth, Model)(pdf)["s"].iloc[0], np.float32)
    assert np.isfinite(score).all() and score.max() < 1e-6
    p = 10.0 ** score[np.searchsorted(keys, asked)].astype(float).reshape(4, 256)
    assert np.abs(p.sum(1) - 1).max() < 1e-5
    assert p.min() > 0 and p[0, 98] < 1e-3 < 0.99 < p[0, 97]


def test_common_pairs_leave_room_for_others():
    """The same of the one table for contexts of two bytes."""
    import pandas as pd

    pairs = [(97, 98, 97), (98, 97, 98)]
    sub = [ctw._subtree(pd.DataFrame({"part": [c], "a": [ctw._pack(np.array([256 * d + x], np.uint16))], "b": [ctw._pack(np.array([3 * 10**9], np.int64))]})).iloc[0] for c, d, x in pairs]
    t = ctw.predictions(sub).reshape(256, 256, 256)[[97, 98, 97, 5], [98, 97, 5, 7]].astype(float)
    assert np.isfinite(t).all() and np.abs((10.0**t).sum(1) - 1).max() < 1e-5
