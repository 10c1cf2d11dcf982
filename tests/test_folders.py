import glob
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from namesift.operators import contrastive
from namesift.sources import resume, sinks
from namesift.sources.arrow_folder import read_arrow_folder


def lines_of(path):
    """Lines of a folder's files, in the order of their names."""
    return [line for f in sorted(glob.glob(f"{path}/part-*")) for line in open(f, encoding="utf-8").read().splitlines()]


def test_files_by_name_are_in_order(spark, tmp_path):
    rows = [((i * 7919) % 1000, f"t{i}") for i in range(1000)] + [(None, "none"), (5, "again")]
    df = spark.createDataFrame(rows, "order int, x string").repartition(7)
    sinks.save_ordered(df, f"{tmp_path}/o", ["order", "x"], files=6)
    got = [json.loads(r) for r in lines_of(f"{tmp_path}/o")]
    assert len(glob.glob(f"{tmp_path}/o/part-*")) == 6
    assert [(r["order"], r["x"]) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r))
    sinks.save_ordered(df, f"{tmp_path}/c", ["order", "x"], "csv", files=3)
    assert sum(1 for _ in lines_of(f"{tmp_path}/c")) == 1002 + len(glob.glob(f"{tmp_path}/c/part-*"))


def test_contrastive_files_are_in_order(spark, tmp_path):
    rec = spark.createDataFrame([(f"a_m1_idx{i}", "forget", 1, "S", f"q{i}", "", "", "x, y, z", [], ["x", "y", "z"]) for i in range(40)], "sample_id string, split_type string, mode int, system_prompt string, user_prompt string, completion string, chosen string, rejected string, valid_packages array<string>, hallucinated_packages array<string>")
    out = sinks.save_contrastive(contrastive.contrastive(rec, n=3), f"{tmp_path}/c")
    assert out["train_all"].count() == 36 * 4
    for part, variant, n in (("train", "original", 36), ("train", "shuffled", 108), ("val", "shuffled", 12)):
        files = sorted(glob.glob(f"{tmp_path}/c/part={part}/variant={variant}/*.parquet"))
        order = [r.order for f in files for r in spark.read.parquet(f).select("order").collect()]
        assert order == sorted(order) and len(order) == n


def test_benchmarks_are_all_there_or_none(spark, tmp_path):
    df = spark.createDataFrame([("humaneval", f"T/{i:02d}", f"s{i}\n\"{k}", k) for i in range(30) for k in range(2)] + [("mbpp", "M/1", None, 0)], "benchmark string, task_id string, solution string, position int").repartition(4)
    path, scores = f"{tmp_path}/run", {"humaneval": {"pass@1": 0.5}, "mbpp": {}, "none": {}}
    sinks.save_benchmarks(df, scores, "m", "ck", path)
    got = [json.loads(x) for x in lines_of(f"{path}/m_humaneval_samples.jsonl")]
    assert got == [{"task_id": f"T/{i:02d}", "solution": f"s{i}\n\"{k}"} for i in range(30) for k in range(2)]
    assert [json.loads(x) for x in lines_of(f"{path}/m_mbpp_samples.jsonl")] == [{"task_id": "M/1", "solution": None}]
    assert json.loads("\n".join(lines_of(f"{path}/m_evalplus_summary.json"))) == {"model": "m", "checkpoint": "ck", "scores": scores}
    with pytest.raises(FileExistsError):
        sinks.save_benchmarks(df, scores, "m", "ck", path)
    with pytest.raises(ValueError, match="without scores"):
        sinks.save_benchmarks(df, {"mbpp": {}}, "m", "ck", f"{tmp_path}/other")
    bad = df.withColumn("solution", F.when(F.col("task_id") == "T/29", F.raise_error(F.lit("lost"))).otherwise(F.col("solution")))
    with pytest.raises(Exception, match="lost"):
        sinks.save_benchmarks(bad, scores, "m", "ck", f"{tmp_path}/broken")
    assert os.listdir(tmp_path) == ["run"]


def test_a_run_goes_on_where_it_broke_off(spark, tmp_path):
    path = f"{tmp_path}/answers"
    todo = spark.createDataFrame([(i, f"p{i}") for i in range(20)] + [(None, "no key")], "row_id long, prompt string")
    answer = lambda d: d.withColumn("answer", F.upper("prompt"))
    assert resume.pending(todo, path, "row_id").count() == 21
    with pytest.raises(FileNotFoundError):
        resume.read_finished(spark, path)
    resume.append(answer(todo.where("row_id < 8")), path, "row_id")
    broken = todo.where("row_id between 5 and 12").withColumn("answer", F.when(F.col("row_id") == 12, F.raise_error(F.lit("lost"))).otherwise(F.col("prompt")))
    with pytest.raises(Exception, match="lost"):
        resume.append(broken, path, "row_id")
    os.makedirs(f"{path}/_attempt-killed-batch=x/rows")  # what a killed run leaves
    left = resume.pending(todo, path, "row_id")
    assert sorted(r.row_id for r in left.where("row_id is not null").collect()) == list(range(8, 20))
    resume.append(answer(left), path, "row_id")
    done = resume.read_finished(spark, path)
    assert sorted((r.row_id, r.answer) for r in done.where("row_id is not null").collect()) == [(i, f"P{i}") for i in range(20)]
    assert resume.pending(todo, path, "row_id").where("row_id is not null").count() == 0


def dataset(path, shards, state=True):
    os.makedirs(path)
    names = []
    for k, rows in enumerate(shards):
        t = pa.table({"input_ids": pa.array([r[0] for r in rows], pa.list_(pa.int32())), "text": pa.array([r[1] for r in rows], pa.large_string()), "n": pa.array([r[2] for r in rows], pa.int64())})
        names.append(f"data-{k:05d}-of-{len(shards):05d}.arrow")
        with pa.OSFile(f"{path}/{names[-1]}", "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
            w.write_table(t, max_chunksize=2)
    if state:
        with open(f"{path}/state.json", "w") as f:
            json.dump({"_data_files": [{"filename": n} for n in names]}, f)


def test_arrow_folder(spark, tmp_path):
    shards = [[([1, 2], "a", 1), (None, None, None), ([], "é", 3)], [([7], "b", 4)], []]
    rows = sorted([tuple(r) for s in shards for r in s], key=repr)
    dataset(f"{tmp_path}/d", shards)
    df = read_arrow_folder(spark, f"{tmp_path}/d")
    assert df.rdd.getNumPartitions() == 3 and df.columns == ["input_ids", "text", "n"]
    assert sorted(map(tuple, df.collect()), key=repr) == rows
    few = read_arrow_folder(spark, f"file://{tmp_path}/d", ["n", "text"])
    assert few.columns == ["n", "text"] and sorted(map(tuple, few.collect()), key=repr) == sorted([(n, t) for _, t, n in rows], key=repr)
    for s in ("train", "test"):
        dataset(f"{tmp_path}/both/{s}", [[([1], s, 1)]], state=s == "train")
    with open(f"{tmp_path}/both/dataset_dict.json", "w") as f:
        json.dump({"splits": ["train", "test"]}, f)
    assert sorted(r.text for r in read_arrow_folder(spark, f"{tmp_path}/both").collect()) == ["test", "train"]
    assert [r.text for r in read_arrow_folder(spark, f"{tmp_path}/both", split="test").collect()] == ["test"]
    with pytest.raises(Exception, match="no split"):
        read_arrow_folder(spark, f"{tmp_path}/both", split="dev").collect()
