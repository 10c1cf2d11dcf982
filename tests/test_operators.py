import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namesift.boundary import EchoGenerator, WordTokenizer, generate, pending, score_pairs
from namesift.operators import align, classify, contrastive, exemplars, masks, metrics, records, report, split, vectors


def names(spark, *x):
    return spark.createDataFrame([(n,) for n in x], "name string")


def test_check_packages(spark):
    df = spark.createDataFrame([(1, ["numpy", "foo", "fp", "a b", "None", "numpy"], ["foo"]), (2, [], None)], "row_id long, Test_1 array<string>, Test_2 array<string>")
    out = {r.row_id: r for r in classify.package_search(df, "row_id", names(spark, "numpy"), names(spark, "fp"), extract=False).collect()}
    assert out[1].valid_1 == ["numpy", "numpy"] and out[1].hallucinated_1 == ["foo"] and out[1].hallucinated_2 == ["foo"]
    assert out[2].valid_1 == [] and out[2].hallucinated_2 == []


def test_pip_and_imports(spark):
    df = spark.createDataFrame([(1, "pip install numpy\npip install numpy\npip install foo\npip install foo", ["os", "cv2", "zzz", "cv2"])], "row_id long, Answers string, mods array<string>")
    r = classify.pip_numbers(df, "row_id", names(spark, "numpy")).first()
    assert (r.pip, r.pip_valid, r.pip_hallucinated) == (["numpy", "numpy", "foo", "foo"], ["numpy", "numpy"], ["foo"])
    r = classify.classify_imports(df, "row_id", "mods", names(spark, "opencv-python")).first()
    assert (r.import_valid, r.import_hallucinated) == (["cv2"], ["zzz"])


#: Published totals of four datasets.
TOTALS = [("LLM_LY", 2568, 5812, 3304, 3653, 16, 4), ("LLM_AT", 2619, 4670, 3067, 6041, 10, 3), ("SO_LY", 2431, 3573, 2690, 7397, 11, 1), ("SO_AT", 3077, 3092, 3400, 4735, 10, 1)]


def test_totals_and_report(spark):
    df = spark.createDataFrame(TOTALS, "dataset string, " + ", ".join(f"{c} long" for c in report.COUNTS))
    t = {r.dataset: r[1:] for r in report.with_totals(df).select("dataset", *report.COUNTS).collect()}
    assert t["Totals"] == (10695, 17147, 12461, 21826, 47, 9)
    runs = report.with_totals(df).where("dataset = 'Totals'").select(F.lit("base").alias("tag"), *report.COUNTS)
    runs = runs.unionByName(spark.createDataFrame([("npo", 26, 18, 28, 17, 0, 0)], "tag string, " + ", ".join(f"{c} long" for c in report.COUNTS)))
    rates, by = report.build_report(runs, [("base", "Base"), ("npo", "NPO"), ("none", "None")])
    a, b = rates.collect()
    assert (a[1], a[2]) == (62.69, 0.0) and b[1] == 39.33 and b[2] == 23.36
    c = by.collect()
    assert (c[0].install_cmd, c[0].nl_query_1, c[0].nl_query_2, c[0].bare_import) == (16.07, 61.59, 63.66, None)
    lists_ = spark.createDataFrame([("a", ["x", "y"], "no list")], "d string, valid_1 array<string>, hallucinated_1 string")
    assert [tuple(r) for r in report.list_totals(lists_, ("valid_1", "hallucinated_1"), "d").orderBy("dataset").collect()] == [("Totals", 2, 0), ("a", 2, 0)]


def results(spark):
    return spark.createDataFrame(
        [
            (0, "f.csv", "p0", "code0", "['numpy']", "['foo']", "[]", "[]", "['numpy', 'foo']", "[]"),
            (1, "f.csv", "nan", "code1", "['numpy']", "[]", "['a']", "[]", "[]", "[]"),
            (2, "f.csv", "p2", None, "[]", "[]", "['b']", "[]", "[]", "[]"),
        ],
        "row_id long, _source_file string, Prompts string, Answers string, valid_1 string, hallucinated_1 string, valid_2 string, hallucinated_2 string, Test_1 string, Test_2 string",
    )


def test_records(spark):
    out = records.extract_records(results(spark)).orderBy("sample_id").collect()
    assert [(r.sample_id, r.split_type, r.completion, r.chosen, r.rejected) for r in out] == [
        ("f.csv_m1_idx0", "forget", "numpy, foo", "numpy", "numpy, foo"),
        ("f.csv_m1_idx1", "retain", "numpy", "numpy", ""),
        ("f.csv_m2_idx2", "retain", "b", "b", ""),
    ]
    assert out[0].user_prompt.endswith("code: code0")
    only = records.extract_records(results(spark), split_type="forget", target="hallucinated_only").collect()
    assert [r.completion for r in only] == ["foo"]
    assert [r.row_id for r in results(spark).where(records.has_hallucination(results(spark))).collect()] == [0]
    assert exemplars.samples(results(spark)).where("label = 0").first().answer == "numpy, foo"


def test_pointwise_and_labels(spark):
    x = records.pointwise(records.extract_records(results(spark)), WordTokenizer(), "qwen", 40).first()
    assert len(x.input_ids) == len(x.labels) == len(x.attention_mask) <= 40
    assert all(a == -100 or a == b for a, b in zip(x.labels, x.input_ids, strict=True)) and x.labels[0] == -100
    bad = spark.createDataFrame([([-100, 7],)], "labels array<int>")
    assert records.check_labels(bad, 8).count() == 1
    with pytest.raises(Exception, match="vocabulary"):
        records.check_labels(bad, 7).collect()


@settings(max_examples=5, deadline=None)
@given(seed=st.integers(0, 10**6), retain_only=st.booleans())
def test_split_has_no_leaks(spark, seed, retain_only):
    rnd = random.Random(seed)
    rows = [(f"s_m{rnd.randint(1, 2)}_idx{i // 2}", rnd.choice(["forget", "retain"]), f"q{rnd.randint(0, 20)}") for i in range(60)]
    out = split.split_by_prompt(spark.createDataFrame(rows, "sample_id string, split_type string, user_prompt string"), 0.2, seed, retain_only).collect()
    assert len(out) == 60
    key = (lambda r: r.user_prompt) if retain_only else (lambda r: r.sample_id.split("idx")[1])
    train, val = ({key(r) for r in out if r.side == s} for s in ("train", "val"))
    if retain_only:
        assert not {r.user_prompt for r in out if r.split_type == "forget"} & val
        assert all(r.split_type == "retain" for r in out if r.side == "val")
    assert not train & val and val


def test_sampling(spark):
    df = spark.createDataFrame([(f"p{i}", "ab"[i % 2]) for i in range(40)], "prompt string, src string")
    out = split.sample_prompts(df, 10, 0.8, by="src").collect()
    assert sorted((r.src, r.side) for r in out) == sorted([("a", "train")] * 8 + [("a", "test")] * 2 + [("b", "train")] * 8 + [("b", "test")] * 2)
    with pytest.raises(Exception, match="fewer than"):
        split.sample_prompts(df, 30, 0.8, by="src").collect()
    with pytest.raises(ValueError, match="share"):
        split.assert_disjoint(df, df)
    assert split.split_rows(df, "prompt", 0.1).where("side = 'val'").count() == 4
    assert split.without_leaks(df, df.limit(0), "prompt").count() == 40 and split.without_leaks(df, df, "prompt").count() == 0


def test_spans_and_masks(spark):
    df = spark.createDataFrame([("numpy, Foo_bar and foo", ["foo-bar", "foo", "numpy"])], "t string, n array<string>")
    spans = df.select(masks.find_names(F.col("t"), F.col("n")).alias("s")).first().s
    assert sorted((x.s, x.e) for x in spans) == [(0, 5), (7, 14), (19, 22)]
    m = spark.sql("SELECT array(named_struct('s',0,'e',3), named_struct('s',3,'e',5), named_struct('s',5,'e',9), named_struct('s',9,'e',9)) t, array(named_struct('s',5,'e',8)) h, array(named_struct('s',0,'e',3)) v")
    assert m.select(masks.response_mask(F.col("t"), F.col("h"), F.col("v")).alias("m")).first().m == [1, 0, 2, 0]
    tri = masks.checked(masks.tri_mask(records.extract_records(results(spark)), WordTokenizer(), single_objective_forget=False)).collect()
    for r in tri:
        assert len(r.input_ids) == len(r.labels) == len(r.tri_mask) and r.tri_mask[-1] == 1
        assert all((a == -100) == (b == 0) for a, b in zip(r.labels, r.tri_mask, strict=True))
    f = next(r for r in tri if r.mode == "forget")
    assert f.tri_mask[-4:] == [1, 0, 2, 1]
    short = masks.tri_mask(records.extract_records(results(spark)), WordTokenizer(), max_length=10)
    assert short.count() == 0
    p = masks.padded(spark.createDataFrame([(0, [1], [1]), (1, [1] * 9, [1] * 9)], "row_id int, input_ids array<int>, labels array<int>"), 2).orderBy("row_id").collect()
    assert [len(r.input_ids) for r in p] == [16, 16] and p[0].labels[1] == -100


def test_contrastive(spark):
    rows = [(f"a_m1_idx{i}", "forget", 1, "S", f"q{i}", "x, numpy, foo, bar", "numpy", "numpy, foo, bar", ["numpy"], ["foo", "bar"]) for i in range(12)]
    rec = spark.createDataFrame(rows, "sample_id string, split_type string, mode int, system_prompt string, user_prompt string, completion string, chosen string, rejected string, valid_packages array<string>, hallucinated_packages array<string>")
    out = contrastive.contrastive(rec, rec.limit(3), n=3).collect()
    assert {r.part for r in out} == {"train", "val"} and sum(not r.is_shuffled_variation for r in out) == 12
    seen = {}
    for r in out:
        assert sorted(r.completion.split(", ")) == ["bar", "foo", "numpy"]
        assert all(r.completion[p.char_start : p.char_end] == p.package_name for p in r.packages_info)
        assert [p.is_hallucinated for p in r.packages_info] == [p.package_name != "numpy" for p in r.packages_info]
        assert r.completion not in seen.setdefault(r.base_sample_id, set())
        seen[r.base_sample_id].add(r.completion)
    with pytest.raises(ValueError):
        contrastive.contrastive(rec.limit(0))


def test_token_spans(spark):
    df = spark.createDataFrame([("numpy, foo",)], "c string").select(F.col("c"), contrastive.locate(F.split("c", ", "), F.array(F.lit("foo"))).alias("info"))
    t = WordTokenizer()
    got = df.withColumn("t", t.tokens(F.col("c"))).select(masks.name_token_spans(F.col("info"), F.col("t"), F.lit(4)).alias("x")).first().x
    assert [(g.package_name, g.positions, g.package_start, g.boundary) for g in got] == [("numpy", [4], 4, 3), ("foo", [6], 6, 5)]


def test_vectors(spark):
    act = spark.createDataFrame([(0, True, [1.0, 0.0]), (0, True, [3.0, 0.0]), (0, False, [0.0, 2.0]), (1, True, [4.0, 0.0]), (1, False, [0.0, 0.0])], "layer int, ok boolean, vec array<double>")
    m = vectors.mean_difference(act, F.col("ok"))
    s = {r.layer: r for r in vectors.layer_stats(m).collect()}
    assert math.isclose(s[0].norm, math.sqrt(8)) and s[0].cosine == 0 and s[1].cosine is None
    assert {r.layer: r.vec for r in vectors.as_arrays(m).collect()} == {0: [2.0, -2.0], 1: [4.0, 0.0]}
    d = vectors.layer_deltas(m).first()
    assert math.isclose(d.delta_norm, math.sqrt(8)) and vectors.largest_jump(vectors.layer_deltas(m)).first()[:2] == (0, 1)
    with pytest.raises(ValueError):
        vectors.require_both(act.where("ok"), F.col("ok"))
    scores = spark.createDataFrame([(0, 1.0, "q", -1.0, -2.0), (0, 1.0, "r", -3.0, -2.0), (1, 1.0, "q", -1.0, -1.0)], "layer int, multiplier double, question string, matching_score double, not_matching_score double")
    done = vectors.steer(scores, [0, 1], [1.0])
    assert vectors.best(done).first().layer == 1
    assert vectors.pending_cells([0, 1, 2], [1.0], done, spark).count() == 1


def test_metrics(spark):
    lp = spark.createDataFrame([([-1.0, -5.0, -3.0, -2.0], [True, False, True, True])], "log_probs array<double>, hits array<boolean>")
    assert lp.select(metrics.min_k(F.col("log_probs"), 0.5).alias("m")).first().m == -4.0
    assert lp.select(metrics.min_k(F.col("log_probs"), 0.1).alias("m")).first().m is None
    assert lp.select(metrics.min_k_accuracy(F.col("log_probs"), F.col("hits"), 0.5).alias("m")).first().m == 0.5
    s = spark.createDataFrame([(0.9, 1), (0.4, 1), (0.4, 0), (0.1, 0)], "s double, y int")
    assert metrics.auc(s, "s", F.col("y") == 1).first().auc == 0.875 and metrics.auc(s, "s", F.col("y") == 0).first().auc == 0.125
    assert metrics.auc(s.where("y = 1"), "s", F.col("y") == 1).first().auc is None
    assert math.isclose(metrics.token_weighted(lp).first().nll, 2.75)
    t = spark.createDataFrame([(1.0, 1, False), (3.0, 2, False), (2.0, 1, True)], "ce double, mask int, is_eos boolean")
    assert metrics.ga_loss(t).first().loss == 1.0 - 1.5 + 4.0
    assert math.isclose(metrics.npo_loss(t).first().l_forget, 0.7 * math.log1p(math.exp(-0.3)))
    assert lp.withColumn("response_start", F.lit(2)).select(metrics.response_score(lp).alias("m")).first().m == -2.5


def test_alignment(spark):
    f = lambda *x: spark.createDataFrame(list(enumerate(x)), "row_id int, response string")
    code = spark.createDataFrame([(0, "p"), (1, "q")], "row_id int, Prompts string")
    assert [tuple(r) for r in align.merge_prompts_and_packages(code, f("a"), f("b", "c", "d")).orderBy("row_id").collect()] == [(0, "p", "a", "b"), (1, "q", None, "c"), (2, None, None, "d")]
    assert align.paired_batches(code, f("a", "b", "c", "d", "e").withColumnRenamed("response", "Prompts"), 1).groupBy("side").count().where("count = 5").count() == 2
    assert align.paired_batches(code, f("a", "b", "c"), 1, cycle=False).agg(F.max("step")).first()[0] == 1
    l = spark.createDataFrame([(1,), (4,), (9,)], "layer int")
    assert sorted(map(tuple, align.layer_pairs(l).collect())) == [(1, 4), (4, 9)] and align.layer_pairs(l, "all").count() == 3 and align.layer_pairs(l, "1-9").count() == 1
    x = align.into_slots(spark.createDataFrame([(2, ["a"], ["a"], [])], "mode int, names array<string>, valid array<string>, hallucinated array<string>")).first()
    assert x.Test_2 == ["a"] and x.Test_1 is None
    m = align.merge_completions(spark.createDataFrame([(0, "old")], "row_index int, completion string"), spark.createDataFrame([(0, "new")], "row_index int, completion string")).first()
    assert (m.completion_original, m.completion) == ("old", "new")


def test_row_numbers(spark):
    rnd = random.Random(8)
    keys = [rnd.randrange(50) for _ in range(300)] + [None, None]
    out = align.row_numbers(spark.createDataFrame([(k,) for k in keys], "k int"), "k", "i", 7).orderBy("i").collect()
    assert [r.i for r in out] == list(range(302)) and [r.k for r in out] == [None, None, *sorted(keys[:300])]
    assert align.row_numbers(spark.createDataFrame([], "k int"), "k", "i", 3).count() == 0


def test_hash_head(spark):
    import hashlib

    keys = [f"k{i}" for i in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    order = sorted(keys, key=lambda k: (hashlib.md5(f"42|{k}".encode()).hexdigest(), k))
    for n in (0, 1, 37, 500, 900):
        assert sorted(r.k for r in split.hash_head(df, "k", n).collect()) == sorted(order[:n])


def test_boundary(spark):
    df = spark.createDataFrame([(0, "use numpy please"), (1, None)], "row_id int, prompt string")
    out = {r.row_id: r.response for r in generate(df, EchoGenerator(2), "prompt").collect()}
    assert out == {0: "numpy, please", 1: ""}
    assert pending(df, df.limit(1)).count() == 1
    p = spark.createDataFrame([("q", "a", "bb")], "question string, answer_matching_behavior string, answer_not_matching_behavior string")
    r = score_pairs(p, lambda q, a: [-float(len(x)) for x in a]).first()
    assert (r.matching_score, r.not_matching_score) == (-1.0, -2.0)
