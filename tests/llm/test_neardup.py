import random

import pytest

from namesift.llm import neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(data, width, percent=80):
    sets = []
    for i, t in data:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    comp = list(range(len(data)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            s, o = sets[a], sets[b]
            if s and o and data[a][0] is not None and data[b][0] is not None and 100 * len(s & o) >= percent * len(s | o):
                comp[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(data):
        r = root(k)
        least[r] = i if r not in least else min(least[r], i)
    return [(i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(data)]


def chains(n, seed):
    """Groups of texts that drift: neighbours are alike, ends often are not."""
    rnd = random.Random(seed)
    out = []
    while len(out) < n:
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([3, 5, 12, 30, 60]))]
        for _ in range(rnd.choice([1, 1, 2, 12])):
            out.append(" ".join(words))
            for _ in range(rnd.choice([0, 1, 1, 2])):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(5000)}"
    rnd.shuffle(out)
    return list(enumerate(out[:n]))


@pytest.mark.parametrize("width, batch", [(2, 256), (2, 7), (5, 256)])
def test_against_brute_force(spark, width, batch):
    data = chains(300, width) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (None, "one"), (906, "a b c d e f g h " * 4000), (907, "a b c d e f g h " * 4001)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], DOCS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    got = neardup.near_duplicates(docs, width)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == sorted(brute(data, width), key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect() if r.doc_id is not None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


@pytest.mark.parametrize("rows", [16, 65_536])
def test_large_group_without_a_common_link(spark, monkeypatch, rows):
    """Many members in one bucket whose first is unlike most of them, met whole or in parts."""
    monkeypatch.setattr(neardup, "GROUP_ROWS", rows)
    rnd = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    data = []
    for i in range(60):
        words = list(base)
        for k in rnd.sample(range(60), 4 + i % 5):
            words[k] = f"x{i}_{k}" if i % 2 else f"y{i % 7}_{k}"
        data.append((i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], DOCS)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 2).collect()) == sorted(brute(data, 2))


def test_keep_one(spark):
    data = [(3, "a b c d e f"), (1, "A b c d e f"), (2, "other words here"), (2, "other words here"), (4, None), (None, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], DOCS)
    out = neardup.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == [1, 2, 4, None]


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert neardup.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_a_chain(spark):
    rnd = random.Random(2)
    ids = list(range(200))
    rnd.shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(1000, 1001)], "a long, b long")
    got = {r.id: r.comp for r in neardup.components(links).collect()}
    assert got == {i: 0 for i in ids} | {1000: 1000, 1001: 1000}
