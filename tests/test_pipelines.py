import json

import pytest

from namesift import cli
from namesift.boundary import WordTokenizer
from namesift.functions.packages import Words
from namesift.operators.split import assert_disjoint
from namesift.plans import pipelines, queries, tables
from namesift.sources import readers

SF = "/root/testdata/sf0.001"
WORDS = Words(frozenset({"the"}))


def frames(spark):
    code = spark.createDataFrame([(0, "p", "pip install numpy\r\nx"), (1, "q", "pip install nope")], "row_id long, Prompts string, Answers string")
    ask = lambda *x: spark.createDataFrame(list(enumerate(x)), "row_id long, response string")
    return code, ask("numpy, nope", "pandas, numpy"), ask("scipy, nope", None)


def test_detection(spark):
    white = spark.createDataFrame([("numpy",), ("pandas",)], "name string")
    fp = spark.createDataFrame([("scipy",)], "name string")
    results, totals = pipelines.detect_packages(*frames(spark), white, fp, WORDS, dataset="d")
    r = results.orderBy("row_id").collect()
    assert (r[0].valid_1, r[0].hallucinated_1, r[0].hallucinated_2, r[0].pip_valid) == (["numpy"], ["nope"], ["nope"], ["numpy"])
    assert (r[1].valid_1, r[1].hallucinated_2, r[1].pip_hallucinated) == (["numpy", "pandas"], [], ["nope"])
    assert totals.where("dataset = 'Totals'").first()[1:] == (3, 1, 0, 1, 1, 1)
    _, both = pipelines.detect_datasets({"a": frames(spark), "b": frames(spark)}, white, fp, WORDS)
    assert both.where("dataset = 'Totals'").first()[1:] == (6, 2, 0, 2, 2, 2)


def test_import_scan_and_slots(spark):
    white = spark.createDataFrame([("numpy",)], "name string")
    rows, sums = pipelines.scan_master(spark.createDataFrame([(0, "p", "import os, numpy\nimport zzz"), (1, "q", None)], "row_id long, Prompts string, Answers string"), white)
    assert rows.where("row_id = 0").first()[2:] == (["numpy"], ["zzz"]) and sums.first().rate == 50.0
    c = spark.createDataFrame([(0, 2, "s", "u", "numpy, zzz")], "row_index long, mode int, system_prompt string, user_prompt string, completion string")
    out = pipelines.score_completions(c, white, None, WORDS).first()
    assert out.valid_2 == ["numpy"] and out.hallucinated_2 == ["zzz"] and out.valid_1 is None
    with pytest.raises(ValueError):
        pipelines.score_completions(c.drop("mode"), white, None, WORDS)


def test_split_and_build(spark):
    rows = [(i, "f.csv", f"prompt {i // 2}", f"code {i}", "['numpy']", "['foo']" if i % 2 else "[]", "['a']", "[]") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, _source_file string, Prompts string, Answers string, valid_1 string, hallucinated_1 string, valid_2 string, hallucinated_2 string")
    x = pipelines.train_test_split(df, 10, 0.8)
    assert x.where("side = 'train'").count() == 8 and x.where("side = 'test'").count() == 2
    assert_disjoint(x.where("side = 'train'"), x.where("side = 'test'"), "Prompts")
    out = pipelines.build_datasets(df, WordTokenizer())
    assert out["records"].where("side = 'val' and split_type = 'forget'").count() == 0
    assert out["tri_mask"].count() == out["records"].count() and out["contrastive"].where("not is_shuffled_variation").count() == 20


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps({"a": {"x": True}}))
    cli.main(["config", "--path", str(tmp_path / "c.json"), "--sections", "a"])
    assert capsys.readouterr().out == "CFG_X=true\n"
    w = lambda n, rows: (tmp_path / n).write_text("\n".join(map(json.dumps, rows)))
    w("code.jsonl", [{"Prompts": "p", "Answers": "pip install numpy"}])
    w("m1.jsonl", [{"response": "numpy, nope"}])
    w("m2.jsonl", [{"response": "numpy"}])
    (tmp_path / "w.csv").write_text("numpy\n")
    (tmp_path / "words.json").write_text(json.dumps({"delete": ["the"], "frameworks": [], "legitimate_packages": [], "func_prefixes": []}))
    run = tmp_path / "runs" / "base"
    cli.main(["detect", *(x for k, v in (("code", "code.jsonl"), ("mode1", "m1.jsonl"), ("mode2", "m2.jsonl"), ("whitelist", "w.csv"), ("words", "words.json")) for x in (f"--{k}", str(tmp_path / v))), "--out", str(run)])
    cli.main(["report", "--runs", str(tmp_path / "runs"), "--tags", "base=Base,x=X", "--out", str(tmp_path / "rep")])
    assert readers.read_tabular(spark, str(tmp_path / "rep" / "table1_hallucination_rate")).first()[1] == "25.0"


def test_every_shape_of_answer_is_there(spark):
    n = {r[0]: r[1] for r in tables.whole_text(spark, SF).groupBy((tables.F.col("doc_id") % 6).alias("k")).count().collect()}
    assert set(n) == set(range(6)) and min(n.values()) > 10


@pytest.mark.parametrize("name", ["hallucination_totals", "tri_mask_counts", "contrastive_shuffles", "strip_code_blocks", "extract_packages"])
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_whitelist_join_is_broadcast_and_native(spark):
    plan = queries.hallucination_totals(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
