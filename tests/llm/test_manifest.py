import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from namesift.llm import manifest
from namesift.llm.common import materialise, table
from namesift.llm.queries import OP11_SQL

DOCS = "doc_id long, text string, source string, lang string, n_chars long"
SF = "/root/testdata/sf0.001"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, source, lang, n_chars):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        p = levels[-1]
        levels.append([H("".join(p[i : i + 16])) for i in range(0, len(p), 16)])
    return levels


def way(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i // 16 * 16
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 16])))
        i //= 16
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0], leaf(*r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in by[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (doc_id, h, r) in enumerate(by[s]):
            w, x = way(trees[s], i) + way(top, k), h
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and r[1] is not None:
                x = leaf(r[0], "".join(c.lower() if c.isascii() else c for c in r[1]), *r[2:])
            for a, b in w:
                x = H(a + x + b)
            out.append((doc_id, h, trees[s][-1][0], top[-1][0], H("".join(a + b for a, b in w)), x, x == top[-1][0]))
    return ordered(out)


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_every_kind_of_row(spark, monkeypatch):
    """Nulls, ends of long, repeated ids, repeated rows, sources that begin alike, a hot source, more rows than a chunk."""
    monkeypatch.setattr(manifest, "MOST", 64)
    monkeypatch.setattr(manifest, "BUCKET", 8)
    rnd = random.Random(3)
    ids = [None, 1 << 62, -(1 << 63), (1 << 63) - 1, 7, 7, *range(5000)]
    data = [(rnd.choice(ids) if i % 3 else i, rnd.choice([None, "", "Ab", "é😀 X", "x" * 5000]), rnd.choice([None, "", "a", "ab", "aé", "zz"]) if i % 4 == 0 else "hot", "en", i % 7 or None) for i in range(6000)]
    data += [(5, "T", "hot", "en", 1)] * 300 + [(9, "one", "lone", None, None)]
    docs = spark.createDataFrame(data, DOCS).withColumns({c: F.col("text") for c in ("rank", "leaf", "grp", "h", "way", "total", "key")})
    assert ordered(manifest.manifest(docs.repartition(5)).collect()) == brute(data)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes(spark, n):
    data = [(i * 1000, f"Text {i}", "s", "en", i) for i in range(n)]
    assert ordered(manifest.manifest(spark.createDataFrame(data, DOCS)).collect()) == brute(data)


def test_many_sources(spark):
    data = [(i, f"Text {i}", f"s{i % 300}", "en", i) for i in range(700)]
    assert ordered(manifest.manifest(spark.createDataFrame(data, DOCS)).collect()) == brute(data)


def test_none(spark):
    assert manifest.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_sql_says_the_same(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = ordered(manifest.manifest(table(spark, SF, "documents")).collect())
    assert got == ordered(duck.execute(OP11_SQL).fetchall()) and 0 < sum(r[-1] for r in got) < len(got)


def test_ranks_of_ids_that_share_all_but_the_last_digits(spark, monkeypatch):
    monkeypatch.setattr(manifest, "MOST", 4)
    monkeypatch.setattr(manifest, "BUCKET", 2)
    keys = [f"{i:016x}" for i in [*range(300), 1 << 40, *range(1 << 50, (1 << 50) + 70)]]
    rows = materialise(spark.createDataFrame([("g" if i % 3 else "f", k) for i, k in enumerate(keys)], "grp string, key string"), "keys")
    got = {(r.grp, r.key): (r["rank"], r.total) for r in manifest.radix_ranks(rows, "grp", "key").collect()}
    for g in "fg":
        own = sorted(k for (x, k) in got if x == g)
        assert [got[g, k] for k in own] == [(i, len(own)) for i in range(len(own))]
