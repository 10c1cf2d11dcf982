import json

import pytest
from pyspark.sql import functions as F

from namesift.operators import contrastive, masks
from namesift.sources import readers, sinks

CSV = 'Prompts,Answers,valid_1\n"say ""hi""\nthere","code, x","[\'numpy\']"\nb,c,[]\n'


def test_results(spark, tmp_path):
    (tmp_path / "A_results.csv").write_text(CSV)
    (tmp_path / "B_results.csv").write_text("Questions,Answers\nq,a\n")
    (tmp_path / "FINAL_RESULTS.csv").write_text("x\n1\n")
    df = readers.read_results(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [(r.row_id, r._source_file, r.Prompts, r.Questions) for r in df] == [(0, "A_results.csv", 'say "hi"\nthere', None), (1, "A_results.csv", "b", None), (2, "B_results.csv", None, "q")]
    assert readers.read_results(spark, [str(tmp_path / "B_results.csv"), str(tmp_path / "none.csv")]).count() == 1
    with pytest.raises(ValueError):
        readers.read_results(spark, [])
    with pytest.raises(FileNotFoundError):
        readers.read_results(spark, str(tmp_path / "none.csv"))


def test_row_ids_over_splits(spark, tmp_path):
    for k, n in enumerate((500, 30, 900)):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k}:{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [r.value for r in readers.with_row_id(spark.read.text(str(tmp_path))).orderBy("row_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{k}:{i}" for k, n in enumerate((500, 30, 900)) for i in range(n)]


def test_records_and_kinds(spark, tmp_path):
    rows = [{"sample_id": "a", "split_type": "forget", "mode": 1}, {"sample_id": "b", "split_type": "retain", "mode": 2, "valid_packages": ["x"]}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "t.jsonl").write_text(json.dumps({"input_ids": [1], "labels": [1], "split_type": "forget", "mode": 1}))
    for name in ("a.json", "l.jsonl"):
        p = str(tmp_path / name)
        assert readers.read_records(spark, p).count() == 2 and readers.read_records(spark, p, "forget").first().completion == ""
        assert readers.read_records(spark, p, modes=(2,)).first().valid_packages == ["x"] and readers.is_preprocessed(spark, p) and not readers.is_tokenized(spark, p)
    assert readers.is_tokenized(spark, str(tmp_path / "t.jsonl")) and readers.read_tokenized(spark, str(tmp_path / "t.jsonl")).first().input_ids == [1]
    assert not readers.is_preprocessed(spark, str(tmp_path / "none"))


def test_strings_names_objects(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('"a \\"q\\""\n\n"b\\nc"\n')
    assert [r.prompt for r in readers.read_strings(spark, str(tmp_path / "p.jsonl")).orderBy("row_id").collect()] == ['a "q"', "b\nc"]
    (tmp_path / "w.csv").write_text("Foo_Bar\nnumpy\nNumPy\n")
    (tmp_path / "f.csv").write_text("1,Foo_x\n2,bar\n")
    (tmp_path / "n.json").write_text('["A_b"]')
    names = lambda d: sorted(r.name for r in d.collect())
    assert names(readers.read_whitelist(spark, str(tmp_path / "w.csv"))) == ["foo-bar", "numpy"]
    assert names(readers.read_false_positives(spark, str(tmp_path / "f.csv"))) == ["Foo_x", "bar"] and names(readers.read_false_positives(spark, str(tmp_path / "f.csv"), True)) == ["bar", "foo-x"]
    assert names(readers.read_name_set(spark, str(tmp_path / "n.json"))) == ["A_b"] and names(readers.read_name_set(spark, str(tmp_path / "w.csv"))) == ["foo-bar", "numpy"]
    (tmp_path / "o.json").write_text('{"mode": 1, "user_prompt": "u"} {"mode": 2}\n{"mode": 1}')
    assert readers.read_split(spark, str(tmp_path / "o.json"), 1).count() == 2
    with pytest.raises(ValueError):
        readers.read_split(spark, str(tmp_path / "o.json"), 3)
    lines = spark.createDataFrame([(0, "1"), (1, '{"a": 1}'), (2, "{bad"), (3, "2")], "row_id int, value string")
    assert readers.finished_prefix(lines).count() == 2


def test_config_and_layers(spark, tmp_path):
    c = {"a": {"b": {"x": 1, "_y": 2, "z": True, "n": {}}}, "d": {"x": "two"}}
    assert readers.settings(c, ["a.b", "d"]) == {"CFG_X": "two", "CFG_Z": "true"} and readers.section(c, "q.r") == {}
    for k in (3, 10):
        (tmp_path / f"vec_layer_{k}_m.pt").write_text("")
    assert readers.vector_layers(spark, str(tmp_path), "m") == [3, 10] and readers.vector_layers(spark, str(tmp_path), "m", [10, 11]) == [10]
    assert readers.matching_results(["layer=1_m=2", "layer=1"], {"layer": 1, "m": None}) == ["layer=1"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", 'a "b"\nc', ["x"])], "Prompts string, Answers string, valid_1 array<string>")
    sinks.save_results(df, df.select(F.lit("Totals").alias("dataset")), str(tmp_path / "r"))
    back = readers.read_tabular(spark, str(tmp_path / "r" / "results")).first()
    assert (back.Answers, back.valid_1) == ('a "b"\nc', '["x"]')
    assert spark.read.csv(str(tmp_path / "r" / "PACKAGE_NAMES"), header=True).columns == ["valid_1"]
    sinks.save_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().valid_1 == ["x"]
    m = spark.createDataFrame([([1], [1], [1], [1])], "input_ids array<int>, attention_mask array<int>, labels array<int>, tri_mask array<int>")
    sinks.save_jsonl(m, str(tmp_path / "f"))
    sinks.save_jsonl(m, str(tmp_path / "g"))
    assert readers.read_token_level(spark, str(tmp_path / "f"), str(tmp_path / "g")).count() == 2
    with pytest.raises(Exception, match="uneven"):
        masks.checked(m.withColumn("labels", F.array(F.lit(1), F.lit(2)))).collect()
    rec = spark.createDataFrame([(f"a_m1_idx{i}", "forget", 1, "S", f"q{i}", "", "", "x, y", [], ["x", "y"]) for i in range(4)], "sample_id string, split_type string, mode int, system_prompt string, user_prompt string, completion string, chosen string, rejected string, valid_packages array<string>, hallucinated_packages array<string>")
    out = sinks.save_contrastive(contrastive.contrastive(rec, n=1), str(tmp_path / "c"))
    assert out["train_all"].count() == 6 and out["train_original"].count() == 3 and out["train_augmented"].count() == 3
