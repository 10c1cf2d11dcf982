import duckdb
import pytest

from namesift.plans import queries, tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    words = lambda i, n: " ".join(f"word{chr(97 + i % 26)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n))
    docs = [(i, "s", words(i, n)) for i, n in enumerate([9, 40, 5, 6, 8, 30, 2, 1, 3, 0])] + [(13, "s", words(13, 24))]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 == 0) for i, *_ in docs], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) as toxic").write.parquet(f"{path}/labels.parquet")
    return path


def test_all_words_are_in_the_answers(spark, folder):
    words = {r.doc_id: r.text.split() for r in tables.table(spark, folder, "documents").collect()}
    rows = {r.doc_id: r for r in tables.whole_text(spark, folder).collect()}
    assert set(rows) == {i for i, w in words.items() if w}
    for i, r in rows.items():
        assert len(r.w) >= 4 and set(r.w) == set(words[i]) and all(w in r.t for w in words[i])


def test_sql_twin_makes_the_same_answers(spark, folder):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = {i: (w, t) for i, _, w, t in duck.execute(tables.DOMAIN).fetchall()}
    assert want == {r.doc_id: (r.w, r.t) for r in tables.whole_text(spark, folder).collect()}


def test_queries_see_whole_texts(spark, folder):
    got = {r.doc_id: r.cleaned for r in queries.strip_code_blocks(spark, folder).collect()}
    assert len(got) == 10 and "wordbbn" in got[1]
    names = {r.doc_id: r.names for r in queries.extract_packages(spark, folder).collect()}
    assert "wordfbd" in names[5] and "wordgaa" in (names[6] or "")
    completions = [r.completion for r in queries.contrastive_shuffles(spark, folder).collect()]
    assert any("wordaag" in c for c in completions)
    assert queries.tri_mask_counts(spark, folder).count() > 0
