from namesift.llm import neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_unlike_texts_under_one_id(spark):
    """Texts that share an id alone are documents of their own: none goes with another, none is dropped for another."""
    t = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    near = t["a"].rsplit(" ", 1)[0] + " z"
    data = [(1, t["a"]), (5, near), (5, t["b"]), (5, t["b"]), (7, t["c"]), (7, t["d"]), (9, t["d"]), (8, None), (None, t["a"])]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in data], DOCS)
    got = neardup.keep_one(docs)
    assert got.columns == docs.columns
    want = [(1, t["a"]), (5, t["b"]), (7, t["c"]), (7, t["d"]), (8, None), (None, t["a"])]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
