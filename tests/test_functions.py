import random
import re

import pytest
from pyspark.sql import functions as F

from namesift.functions import imports, lists, naming, packages, prompts, text


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "f, given, want",
    [
        (text.normalize_python_package, "Foo_Bar.", "foo-bar"),
        (text.normalize_python_package, "web3.py", "webpy"),
        (text.normalize_python_package, "1. a\nb\n", "a b"),
        (text.normalize_python_package, "٣. x", "x"),
        (text.normalize_package, '"1) Foo__bar"', "1) foo-bar"),
        (text.normalize_package, "1) 'Foo__bar'", "foo-bar"),
        (text.normalize_package, None, ""),
        (text.normalize_pip, "(Foo.bar)", "foo-bar"),
        (text.normalize_pip, None, None),
        (text.normalize_python_legacy, "1. Foo_", "foo"),
        (text.normalize_javascript, "`a`", "a"),
        (text.after_reasoning, "x</think> y ", "y"),
        (text.without_null_words, " NaN ", ""),
        (text.strip, "\x1c a　", "a"),
    ],
)
def test_strings(spark, f, given, want):
    assert one(spark, f, given) == want


def test_sql_functions(spark):
    text.register(spark)
    assert spark.sql("SELECT normalize_python_package('2. Foo_Bar.') AS a, normalize_pip('(X.y)') AS b").first() == ("foo-bar", "x-y")


@pytest.mark.parametrize("given, want", [("['a', 'b']", ["a", "b"]), ("a, b", ["a", "b"]), ("[]", []), ("nan", []), (None, []), ('["a"]', ["a"]), ("['it\\'s', None]", ["it's", "None"]), ("('a', 'b')", ["a", "b"]), ("[1, 2]", ["1", "2"])])
def test_parse_list(spark, given, want):
    assert one(spark, lambda x: lists.parse_package_list(x, exact=True), given) == want


def test_list_size_and_format(spark):
    assert one(spark, lists.list_size, "['a', 'b']") == 2 and one(spark, lists.list_size, "x") == 0 and one(spark, lists.list_size) == 0
    assert one(spark, lambda x: lists.format_packages(F.array(F.lit(""), F.lit("a"), F.lit("b")))) == "a, b"
    assert one(spark, lambda x: lists.format_packages(lists.empty())) == "None"


def test_pip(spark):
    t = "pip install a b\npip  install -U c\npip install d==1.0"
    assert one(spark, packages.parse_pip_install, t) == ["a", "d==1.0"]
    assert one(spark, lambda x: packages.parse_pip_install(x, True), t) == ["a", "b", "c", "d==1.0"]
    assert one(spark, packages.parse_pip_install) == []
    items = F.array(*map(F.lit, ["foo[bar]", "d==1.0", "git+https://x", "Foo_Bar>=2", "requirements.txt", "--x y"]))
    assert one(spark, lambda x: packages.clean_pips(items)) == ["foobar", "d", "foo-bar", "y"]


def test_code_blocks(spark):
    f = packages.strip_code_blocks
    assert one(spark, f, "a\n```python\nimport x\n```\nb") == "a\n\n\nb"
    assert one(spark, f, "a ```py\nimport x") == "a "
    assert one(spark, f, "```\npip install q\n```\nz") == "\n\nz\npip install q"
    assert one(spark, f, "x `a\nb` y") == "x \n y"


def test_prose(spark):
    assert one(spark, packages.prose_cut, "a, b\nNote: c Explanation: d") == "a, b\nNote: c "
    assert one(spark, packages.prose_cut, "a note: b") == "a "


def loop(t):
    """The definition with counted repeats, written anew."""
    lines = t.split("\n")
    bare = [re.sub(r"^\s*\d+[.)]\s*", "", x).strip() for x in lines]
    full = [x for x in bare if x]
    for c in range(3, min(20, len(full) // 3) + 1) if len(full) >= 9 else []:
        n = 1
        while full[n * c : (n + 1) * c] == full[:c]:
            n += 1
        if n >= 3:
            at = seen = 0
            for line, b in zip(lines, bare, strict=True):
                if seen >= c:
                    return at
                seen += bool(b)
                at += len(line) + 1
            return at
    return 0


def test_loops(spark):
    rnd = random.Random(3)
    texts = ["\n".join(["a", "b", "c", "d"] * 3), "x\ny"]
    for _ in range(150):
        unit = [rnd.choice(["a", "b", "1. a", " 2) b", "", "é"]) for _ in range(rnd.randint(2, 6))]
        texts.append("\n".join(unit * rnd.randint(1, 5) + [rnd.choice("ab")] * rnd.randint(0, 2)))
    got = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", packages.loop_start(F.col("x")).alias("y")).collect()
    assert {r.i: r.y for r in got} == {i: loop(t) for i, t in enumerate(texts)}
    assert loop(texts[0]) == 8


def test_extract(spark):
    data = [
        "1. `numpy`\n2. pandas\n3. worker from multiprocessing",
        "numpy, scikit_learn, print_it, foo_path, requests, a.b.c, Django, x",
        "You can install things by hand, of course it is easy",
        "Sure: `torch` and 'Flask-Login'\\n`torch`",
        None,
        "word " * 500,
    ]
    df = spark.createDataFrame(list(enumerate(data)), "i int, t string")
    words = packages.Words(delete=frozenset({"sure", "and", "things"}))
    got = {r.i: r.n for r in packages.extract_packages(df, "t", "n", words).collect()}
    assert got[0] == ["numpy", "pandas"]
    assert got[1] == ["numpy", "scikit-learn", "requests"]
    assert got[3] == ["torch", "flask-login"]
    assert got[4] == [] and got[5] == []


def test_families(spark):
    assert one(spark, lambda x: packages.split_legacy(x, "DeepSeek", True, True), "a b, `numpy`\\npandas, and, :tox:") == ["numpy", "pandas", "tox"]
    assert one(spark, lambda x: packages.after(x, "Openchat"), "gpt4numpyggg") == "numpy"
    assert one(spark, lambda x: packages.after(x, "Mistral"), "bash") == ""
    assert packages.steps_for("Mistral_7B", "Python") == (True, True, "Mistral") and packages.steps_for("x", "Python") == (False, False, "")


def test_imports(spark):
    ok = "import numpy as np, os.path\nfrom a.b import c\nfrom . import d\ndef f():\n    import zlib"
    bad = "import numpy\nfrom x.y import z\nthis is not code\n  import q.r"
    assert sorted(one(spark, imports.top_level_imports, ok)) == ["a", "numpy", "os", "zlib"]
    assert one(spark, imports.top_level_imports, bad) == ["numpy", "x", "q"]
    assert one(spark, imports.top_level_imports) == []


def test_chat(spark):
    msgs = lambda x: prompts.messages(F.lit("S"), F.lit("U"))
    assert one(spark, lambda x: prompts.chat(msgs(x), "qwen", True)) == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\n"
    assert one(spark, lambda x: prompts.chat(msgs(x), "deepseek", True, "<s>")) == "<s>S### Instruction:\nU\n### Response:\n"
    assert one(spark, lambda x: prompts.chat(msgs(x), "llama3")).startswith("<|start_header_id|>system<|end_header_id|>\n\nS<|eot_id|>")
    assert one(spark, lambda x: prompts.solution(F.lit("def f():\n"), x), "Here:\n```python\n    return 1\n```\nbye") == "def f():\n    return 1\n"
    assert one(spark, lambda x: prompts.question(F.lit(""), F.lit("u"))) == "u"
    assert prompts.family_of("Qwen2.5-Coder") == "qwen" and prompts.family_of("other") == "llama3"
    assert one(spark, lambda x: prompts.prefix(F.lit(1), x), "k") in prompts.PREFIXES[1]


def test_naming():
    assert naming.layer_pairs("0-1, 3-7,0-1", []) == [(0, 1), (3, 7)]
    assert naming.layer_pairs("adjacent", [1, 4, 9]) == [(1, 4), (4, 9)] and len(naming.layer_pairs("all", [1, 2, 3])) == 3
    assert naming.parse_scores("Base\n{'pass@1': 0.5}\nBase + Extra\npass@1: 0.25") == {"base": {"pass@1": 0.5}, "plus": {"pass@1": 0.25}}
    assert naming.pass_at({"base": {"pass@1": 0.5}}) == 0.5 and naming.settings_suffix({"layer": 3, "x": None, "m": "a/b"}) == "layer=3_m=a-b"
