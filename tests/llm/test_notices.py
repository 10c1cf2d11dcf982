"""Standard licence notices, wrapped and on one line, and marks of short texts' fingerprints."""

import duckdb
import pytest

from namesift.llm import fingerprint, licences, queries

GPL = "This program is free software{c} you can redistribute it and/or modify\nit under the terms of the GNU {f}General Public License as published by\nthe Free Software Foundation{s} either version {v} of the License, or\n(at your option) any later version."
MIT = 'Copyright (c) 2020 A B\n\nPermission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files (the "Software"), to deal\nin the Software.\n\nThe above copyright notice and this permission notice shall be\nincluded in all copies.'
BSD = "Redistribution and use in source and binary\nforms, with or without modification, are permitted.\n\n3. Neither the name of the copyright holder nor the names of its contributors\nmay be used to endorse or promote products."
CASES = [
    (GPL.format(c=";", f="", s=";", v="2"), "GPL-2.0-or-later"),
    (GPL.format(c=":", f="", s=",", v="3"), "GPL-3.0-or-later"),
    (GPL.format(c=":", f="Lesser ", s=",", v="3"), "LGPL-3.0-or-later"),
    (GPL.format(c=":", f="Lesser ", s=";", v="2.1"), "LGPL-2.1-or-later"),
    (GPL.format(c=":", f="Affero ", s=",", v="3"), "AGPL-3.0-or-later"),
    (MIT, "MIT"),
    (BSD, "BSD-3-Clause"),
    ("Licensed under the\nApache License, Version 2.0.", "Apache-2.0"),
    ("This is NOT released under the MIT license.", ""),
    ("Released under the MIT License.\n\nlicensed under CC BY 4.0", "MIT,CC-BY-4.0"),
]


def forms(t):
    return t, t.replace("\n", "\r\n"), "\n".join(f"# {x}".rstrip() for x in t.split("\n")), "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */"


@pytest.mark.parametrize("text, want", CASES)
def test_notices(spark, text, want):
    rows = [(i, t) for i, t in enumerate((*forms(text), text.replace("\n\n", "\0").replace("\n", " ").replace("\0", "\n\n")))]
    got = {r.doc_id: r.licences for r in licences.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want for i, _ in rows}


def test_sql_agrees(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(f for c, _ in CASES for f in forms(c))] + [(99, None), (99, "")], "doc_id long, text string")
    documents = df.toPandas()  # noqa: F841
    want = duckdb.sql(queries._op2_sql()).fetchall()
    got = licences.detect(df).select("doc_id", "n_sentences", "sentence_ids", "licences").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_repeats_and_clashes(spark):
    df = spark.createDataFrame([(1, CASES[0][0], "x"), (1, CASES[0][0], "y"), (None, CASES[5][0] * 2000, "z")], "doc_id long, text string, licences string")
    assert sorted((r.doc_id or 0, r.licences) for r in licences.detect(df).collect()) == [(0, "MIT"), (1, "GPL-2.0-or-later"), (1, "GPL-2.0-or-later")]


def test_marks():
    texts = [" ".join(f"t{i}w{j}" for j in range(1 + i % 20)).encode() for i in range(400)]
    exact = [set(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (t.split() for t in texts)]
    long = fingerprint.sketches([t + b" " + b" ".join(b"z%d" % k for k in range(300)) for t in texts])
    n = 0
    for i, s in enumerate(fingerprint.sketches(texts)):
        assert (fingerprint.of_text(fingerprint.text_of(s)) == s).all() and s.size >= 1
        assert s.size == 1 or not fingerprint.marked(s)
        n += fingerprint.marked(s)
        assert fingerprint.containment(s, s) == 1.0
        if len(texts[i].split()) >= 5:  # contained whole: all or, of a mark, nothing
            assert exact[i] and fingerprint.containment(s, long[i]) == (0.0 if fingerprint.marked(s) else 1.0)
        assert fingerprint.merge(fingerprint.text_of(s), fingerprint.text_of(long[i])) == fingerprint.text_of(_union(s, long[i]))
    assert 50 < n < 300
    a, b = (fingerprint.text_of(x) for x in fingerprint.sketches([b"q1", b"q7"]))
    assert fingerprint.merge(a, b) == fingerprint.merge(b, a) and fingerprint.merge(a, "") == a


def _union(a, b):
    x = sorted({int(v) for v in a} | {int(v) for v in b})
    x = [v for v in x if v < fingerprint.LIMIT] or x[:1]
    return fingerprint.np.array(x, fingerprint.np.uint64)
