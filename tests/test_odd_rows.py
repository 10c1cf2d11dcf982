"""Every query over tables with nulls, empty, blank and very long texts, lone words, repeated rows, or no rows at all."""

import pytest

from namesift.plans import file_queries, queries  # noqa: F401  file_queries adds its own

TEXTS = [None, "", " ", "\n\t\r", "one", "1", "two words", "..", "`", "```python\n", "1. `a`\n2) b", "pip install", "pip install x y", "import os\nfrom", "<think>x", "ſ é😀 İ", "a,b,,c\n,", "nan", "None", "x" * 3000, "word " * 3000, "1.2." * 300, "and the and the and the and the"]


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(spark, request, tmp_path_factory):
    path = str(tmp_path_factory.mktemp(request.param))
    texts = TEXTS if request.param == "odd" else []
    n = len(texts)
    docs = [(i, t, [None, "en", "de"][i % 3], [None, "", "src"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    docs += docs[-1:] + ([(None, "no id", "en", "src", 5)] if n else [])
    vec = [None, [], [None] * 4, [0.0] * 4, [1.0, 2.0, 3.0, 4.0], [float("nan")] * 4, [0.5, -0.5, 0.1, 0.2]]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, [None, 0, 1][i % 3], i % 2) for i in range(n)], "doc_id long, quality int, toxic int"),
        "embeddings": ([(i, v, [None, 1, 2][i % 3]) for i, v in enumerate(vec[:n])], "vec_id long, embedding array<float>, label int"),
        "pages": ([(i, None if i == 1 else f"http://x/{i}", t) for i, t in enumerate(texts[:3])], "page_id long, url string, html string"),
        "benchmark": ([(i, t) for i, t in enumerate(texts[:4])], "item_id long, text string"),
        "conversations": ([(i // 2, i % 2, ["user", "assistant", "system", None][i % 4], t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path, n


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_query_fails(spark, folder, name):
    path, n = folder
    if name == "contrastive_shuffles" and not n:
        with pytest.raises(ValueError, match="no records"):
            queries.QUERIES[name](spark, path)
        return
    queries.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
