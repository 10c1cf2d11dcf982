import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from namesift.llm import bpe, ctw, fingerprint, licences, linedup, mixing, neardup, quality, queries, secrets
from namesift.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
#: Lines are compared with A to Z as lower case, as OP7_SQL has it.
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spans(t):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for k, (kind, p, n) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(p, t) if m.end() - m.start() >= n]
    return sorted(out)


def test_secrets(spark):
    rnd = random.Random(1)
    parts = ["token=abc", "password: 'hunter22'", "API_KEY = x" * 2, "AKIA" + "A1" * 9, "AKIAAKIA" + "B" * 14, "AKIAshort", "deadbeef" * 3, "deadbeef" * 2 + "é", "secret: key", "password: token: abcdefgh", "é😀 ", "x", "-----BEGIN RSA PRIVATE KEY-----", "http://a:b@c", " ", "\n"]
    data = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))) for i in range(150)] + [(900, None), (901, ""), (902, "deadbeef" * 3 + " x" * 50_000 + " token=abcdef"), (3, "dup"), (None, "token=abcdef")]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in data], DOCS)
    got = secrets.digest(docs).collect()
    assert len(got) == len(data)
    want = []
    for i, t in data:
        s = spans(t or "")
        base = ",".join(f"{k}:{a}:{e}" for a, _, k, e in s)
        want.append((i, *(sum(x[1] == o for x in s) for o in range(3)), hashlib.sha256(base.encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    one = next(r for r in got if r.doc_id == 902)
    assert one.spans.startswith("hex:0:24,assign:")
    assert secrets.digest(docs.limit(0)).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    a = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "clean")], "doc_id long, text string")
    ledger.update(a)
    assert ledger.scans().count() == 2 and ledger.findings().count() == 1
    b = a.union(spark.createDataFrame([(4, "password=abcdef")], a.schema))
    ledger.update(b)
    assert ledger.scans().count() == 3 and ledger.findings().count() == 2
    ledger.update(b)
    assert ledger.scans().count() == 3 and ledger.findings().count() == 2
    ledger.update(b, version=2)
    assert ledger.scans().count() == 6 and ledger.findings(2).count() == 2
    assert {r.doc_id: r.n_assign for r in secrets.digest(b, ledger).collect()} == {1: 1, 2: 1, 3: 0, 4: 1}


@pytest.mark.parametrize(
    "text, want",
    [
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("Some prose here. Released under the MIT License. More prose.", "MIT"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("Under the GNU Lesser General Public License, version 3; or (at your option) any later version.", "LGPL-3.0-or-later"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("LICENSED UNDER CC BY 4.0\nReleased under the MIT License.", "MIT,CC-BY-4.0"),
        ("Licensed under the Apache License, Version 2.0.\nSee http://www.apache.org/licenses/LICENSE-2.0", "Apache-2.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of it. The above copyright notice and this permission notice shall be included.", "MIT"),
        ("This is licensed under the Foo License.", "unknown-licence"),
        ("A licence to kill.", ""),
        ("nothing", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_licences(spark, text, want):
    r = licences.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.licences == want and (r.n_sentences > 0) == bool(r.sentence_ids)


def test_licences_tables(spark):
    assert licences.detect(spark.createDataFrame([], DOCS)).count() == 0
    ids = {s.id for s in licences.SENTENCES}
    assert {x for r in licences.RULES for x in r.sequence} <= ids


def test_pipeline_stages(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    want = {r.doc_id for r in quality.score(docs, quality.fit(docs, labels)).where("score >= 0.7").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want and 100 < len(want) < 200
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good - want) <= 0.05 * len(good)
    lines = corpus_pipeline.drop_lines(spark, kept, SF).cache()
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    seen, gone = [], 0
    clean = {}
    for i, t in rows:
        out = []
        for line in t.split("\n"):
            s = frozenset(line.translate(FOLD).split())
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                gone += 1
            else:
                out.append(line)
            if s:
                seen.append(s)
        clean[i] = "\n".join(out)
    assert gone and {r.doc_id: (r.text, r.n_chars) for r in lines.collect()} == {i: (t, len(t)) for i, t in clean.items()}
    near = corpus_pipeline.drop_near_duplicates(spark, lines, SF).cache()
    least = {r.doc_id for r in neardup.near_duplicates(lines, 5).collect() if r.kept}
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == least
    mixed = corpus_pipeline.mix_sources(spark, near, SF).cache()
    copies = {r.doc_id: r.copies for r in mixing.copies(near).collect() if r.copies}
    assert mixed.columns == docs.columns and {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies
    out = corpus_pipeline.encode(spark, mixed, SF).collect()
    codec = bpe.Codec(queries.tokenizer_path())
    texts = {r.doc_id: r.text for r in near.collect()}
    assert len(out) == sum(copies.values())
    for r in out:
        assert r.n_tokens == len(r.token_ids) and codec.decode(r.token_ids) == texts[r.doc_id] and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pipeline_on_odd_rows(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta. iota kappa lambda mu."
    docs = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, text, "en", None, 9), (3, text, "en", None, 9), (None, text, "en", "a", 9)], DOCS)
    docs = docs.withColumns({c: F.lit(1) for c in ("score", "predicted", "gone", "n_lines", "th", "sid", "component_id", "gone_id", "copies", "h", "size", "token_ids", "n_tokens", "decoded")})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.collect()
    assert linedup.dedup(docs.limit(0)).count() == 0
    for f in (ctw.score, secrets.digest, licences.detect, fingerprint.compare_neighbours, mixing.report, neardup.near_duplicates, linedup.report):
        assert f(docs).count() == 5, f
    assert corpus_pipeline.encode(spark, docs, SF).count() == 5
