"""Steps that were squares of their input, against plain versions and on long inputs."""

import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namesift.functions import finding, packages
from namesift.operators import align, classify, contrastive, masks, metrics, split

DESCRIBED = re.compile(packages.DESCRIBED, re.IGNORECASE)
NAMES = st.lists(st.lists(st.text(alphabet="abékſi1+", max_size=2), min_size=1, max_size=3).map("-".join), max_size=5)


def plain_spans(text, names):
    out = []
    for k in sorted(dict.fromkeys(names), key=lambda k: (-len(k), k)):
        parts = [re.escape(p) for p in k.split("-") if p]
        for m in re.finditer(rf"\b{'[-_.]+'.join(parts)}\b", text, re.IGNORECASE) if parts else ():
            if all(m.end() <= s or e <= m.start() for s, e in out):
                out.append(m.span())
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="abA-_. ,éÉſsKkİiı+1\n", max_size=30), NAMES, NAMES)
def test_spans_of_names(text, names, of_other_rows):
    assert finding.NameFinder({*names, *of_other_rows}).spans(text, names) == plain_spans(text, names)


def plain_list(text):
    items = re.findall(r"(\d+[.)])\s*[`']?([a-zA-Z0-9\-_.]+)[`']?", text)
    line = lambda n, p: re.search(re.escape(n) + r"\s*[`']?" + re.escape(p) + r"[`']?[^\n]*", text).group()
    kept = [p for n, p in items if len(p) > 2 and not DESCRIBED.search(line(n, p))]
    return kept if len(items) >= 2 and len(kept) >= 2 else None


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["1.", "2)", "11.", "1)", " ", "\n", "`", "'", "foo", "foobar", "a2.", "2.3", "from", "class ", "(defined", "x.y-z", "\t", "é", "12", ".", "\x00", "\x01", "\x1c"]), max_size=16).map("".join))
def test_numbered_lists(text):
    assert finding.listed(text, DESCRIBED) == plain_list(text)


def test_long_lists_and_texts_take_no_square(spark):
    began = time.perf_counter()
    text = "\n".join(f"{i}. name{i}-x from y" if i % 3 else f"{i}. `name{i}`" for i in range(100_000))
    assert len(finding.listed(text, DESCRIBED)) == 33_334 and finding.listed("1." * 100_000, DESCRIBED) is None
    names = [f"name-{i}" for i in range(50_000)]
    spans = finding.NameFinder(set(names)).spans(" ".join(names).replace("-", "_."), names)
    assert len(spans) == 50_000
    s, e = (np.array(x) for x in zip(*sorted(spans), strict=True))
    tokens = np.arange(0, 400_000, 2)
    assert finding.overlapping(tokens, tokens + 2, s, e).sum() > 100_000
    p = finding.Positions(tokens, tokens + 2)
    assert [p.within(int(a), int(b)) for a, b in zip(s[:50_000], e, strict=False)][0] == [0, 1, 2, 3]
    assert time.perf_counter() - began < 30
    many = spark.createDataFrame([([f"n{i}" for i in range(100_000)],)], "n array<string>").select(F.explode(contrastive.locate(F.col("n"), F.col("n"))).alias("p"))
    assert many.where("p.is_hallucinated").count() == 100_000 and time.perf_counter() - began < 60


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 4)), max_size=12), st.lists(st.tuples(st.integers(0, 25), st.integers(1, 6)), max_size=4), st.booleans())
def test_positions_against_spans(tokens, spans, sort):
    tokens = sorted(tokens) if sort else tokens
    s, e = (np.array([t[0] for t in tokens], np.int64), np.array([t[0] + t[1] for t in tokens], np.int64))
    apart, end = [], 0
    for a, n in spans:
        apart.append((end + a, end + a + n))
        end += a + n
    want = [e[i] > s[i] and any(s[i] < b and e[i] > a for a, b in apart) for i in range(len(tokens))]
    assert finding.overlapping(s, e, np.array([a for a, _ in apart], np.int64), np.array([b for _, b in apart], np.int64)).tolist() == want
    p = finding.Positions(s, e)
    for a, b in apart:
        assert p.within(a, b) == [i for i in range(len(tokens)) if s[i] < b and e[i] > a]
        assert p.nearest(a) == (min(range(len(tokens)), key=lambda i: (abs(s[i] - a), i)) if tokens else None)


def test_find_names_of_odd_rows(spark):
    rows = [("numpy, Foo_bar and foo", ["foo-bar", "foo", "numpy"]), (None, ["x"]), ("", ["x"]), ("x", None), ("x", []), ("x y", ["x", None, "", "--"]), ("é😀 x", ["x"])]
    df = spark.createDataFrame(rows, "t string, n array<string>")
    assert [[(x.s, x.e) for x in r.s] for r in df.select(masks.find_names(F.col("t"), F.col("n")).alias("s")).collect()] == [[(7, 14), (0, 5), (19, 22)], [], [], [], [], [(0, 1)], [(3, 4)]]


def plain_auc(rows):
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    key = lambda s: (0, 0) if s is None else (2, 0) if math.isnan(s) else (1, s)  # noqa: E731  null first, NaN last
    wins = sum(1.0 if key(a) > key(b) else 0.5 if key(a) == key(b) else 0 for a in p for b in n)
    return wins / (len(p) * len(n)) if p and n else None


@pytest.mark.parametrize("parts", [1, 2, 9, 40])
def test_auc_over_ranges(spark, parts):
    """Ties lie on the borders of ranges, as there are fewer scores than ranges."""
    rnd = random.Random(parts)
    rows = [(g, rnd.choice([0.0, 0.5, 1.0, 1.5, 2.0, None, float("nan"), rnd.random()]), rnd.random() < 0.4) for g in ("a", "b", None) for _ in range(120)] + [("one", 1.0, True)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    got = {r.g: r.auc for r in metrics.auc(df, "s", F.col("y"), ["g"], parts).collect()}
    assert set(got) == {"a", "b", None, "one"} and got["one"] is None
    for g in ("a", "b", None):
        assert got[g] == pytest.approx(plain_auc([(s, y) for k, s, y in rows if k == g]))
    assert metrics.auc(df, "s", F.col("y"), parts=parts).first().auc == pytest.approx(plain_auc([(s, y) for _, s, y in rows]))
    plan = metrics.auc(df, "s", F.col("y"), parts=parts)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\(s#", plan)  # each window has a range to part by


def test_sums_before(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("xy"), rnd.randrange(10)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, g string, v int").repartition(5)
    got = {r.k: r.b for r in align.sums_before(df, "k", F.col("v"), "b", ["g"], 7).collect()}
    assert got == {k: sum(v for j, h, v in rows if h == g and j < k) for k, g, _ in rows}


@pytest.mark.parametrize("small", [True, False])
def test_one_name_in_half_of_all_rows(spark, monkeypatch, small):
    monkeypatch.setattr(classify, "BROADCAST_BYTES", 1 << 60 if small else -1)
    rows = [(i, "hot" if i % 2 else f"n{i}") for i in range(4000)] + [(1, "hot")] * 10 + [(2, None)] * 3
    df = spark.createDataFrame(rows, "i int, name string").repartition(4)
    white = spark.createDataFrame([("hot",), ("n2",), ("n2",), (None,)], "name string")
    fp = spark.createDataFrame([("n4",), ("hot",)], "name string")
    got = classify.flag(df, white, fp)
    want = sorted(((i, n, n in ("hot", "n2")) for i, n in rows if n != "n4"), key=repr)
    assert sorted(((r.i, r.name, r.is_valid) for r in got.collect()), key=repr) == want and got.columns == ["i", "name", "is_valid"]
    if not small:
        x, _ = classify._salted(df, "name")
        per = {r[0]: r[1] for r in x.where("name = 'hot'").groupBy("__salt").count().collect()}
        assert len(per) > 32 and max(per.values()) < 200 and x.where("name <> 'hot' and __salt > 0").count() == 0


def test_planning_a_lookup_runs_no_job(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("n"), F.col("id") % 7).alias("name"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "a lookup")
    classify.flag(df, df.select("name"))
    assert len(tracker.getJobIdsForGroup("planning")) == 0
    spark.sparkContext.setJobGroup("tests", "tests")


def test_orders_by_rank(spark):
    df = spark.createDataFrame([(list("abcd"), i) for i in range(24)] + [(list("aab"), i) for i in range(6)], "x array<string>, r long")
    got = ["".join(r[0]) for r in df.select(contrastive.unranked(F.col("x"), F.col("r"))).collect()]
    assert sorted(got[:24]) == sorted(map("".join, itertools.permutations("abcd"))) and sorted(got[24:]) == sorted(map("".join, itertools.permutations("aab")))
    k = spark.createDataFrame([(n,) for n in (1, 2, 5, 26, 27, 1000, 1001, 200_000)], "k int").select("k", contrastive._orders(F.col("k")).alias("n"), contrastive._chosen(F.col("k")).alias("m")).collect()
    assert all(r.n == math.perm(r.k, r.m) < 1 << 62 for r in k) and k[0].n == 1 and k[2].n == 120


def test_variations_are_all_there_are(spark):
    cols = "sample_id string, split_type string, mode int, system_prompt string, user_prompt string, completion string, chosen string, rejected string, valid_packages array<string>, hallucinated_packages array<string>"
    lists = [["a", "b"], ["a", "b", "c"], ["a"], ["a", "a", "b"], ["a", "a"], [f"n{i}" for i in range(30)], [f"n{i}" for i in range(1200)], ["x", "y", "x"]]
    rec = spark.createDataFrame([(f"s{i}", "forget", 1, "S", f"q{i}", "", "", ", ".join(n), [], n) for i, n in enumerate(lists)], cols)
    x = contrastive.variations(contrastive.originals(rec), 4)
    assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()
    by = {}
    for r in x.collect():
        by.setdefault(r.base_sample_id, []).append(r.completion)
    for i, n in enumerate(lists):
        got = by.get(f"s{i}", [])
        there = math.factorial(len(n)) // math.prod(math.factorial(n.count(v)) for v in set(n)) - 1 if len(n) < 9 else 99
        assert len(got) == len(set(got)) == min(4, there) and ", ".join(n) not in got and all(sorted(c.split(", ")) == sorted(n) for c in got)


def test_generator_order_is_for_few_groups(spark, monkeypatch):
    monkeypatch.setattr(split, "PYTHON_KEYS", 5)
    df = spark.createDataFrame([(f"a{i}", f"p{i}", "retain") for i in range(6)], "sample_id string, user_prompt string, split_type string")
    assert split.split_by_prompt(df.limit(5), 0.4, order="python").where("side = 'val'").count() == 2
    with pytest.raises(ValueError, match="more than 5 groups"):
        split.split_by_prompt(df, 0.4, order="python")
