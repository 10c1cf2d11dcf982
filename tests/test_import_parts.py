import ast
import random
import warnings

from pyspark.sql import functions as F

from namesift.functions import imports
from namesift.operators import classify

#: Statements and what only looks like them, which stand below each other in any order.
PIECES = [
    "import a", "import a.b as c, d", "import a . b", "import class", "from x import y", "from .x import y", "from x import (a,\n  b as q,)", "from x import(a)", "from x import a,", "from x import *", "from x.import y", "from x importy",
    "import é", 's = """\nimport q\n"""', "s = '''", "'''", "def f():\n    import k.l\n    from m import (n,\n o)", "    import j", "def f():\n    import k\n  import l", "if x:\n    import t\nelse:\n    from u import v", "else:",
    "try:\n  import a1\nexcept E:\n  import a2\nfinally:\n  import a4", "match x:\n  case 1:\n    import b1", "x = (", "\n", ")", "# import c", "x = 1 \\", "class C:\n  def g(self):\n    import g1\n  import g2", "import a; import b9", "import a\r",
    "from __future__ import annotations", '"""', "import a \\\n, b", "from a import ()", 's = """x""" + 1', 'None = """x"""', "import a\0", "@d", "import a as b.c", "   ", "\x0c",
]


def whole(text):
    """What the tree of all the text has, by depths."""
    try:
        level, found = [ast.parse(text)], []
    except (SyntaxError, ValueError):
        return None
    while level:
        found += [m for node in level for m in imports._modules(node)]
        level = [x for node in level for x in ast.iter_child_nodes(node)]
    return found


def test_parts_of_code_have_what_the_whole_has():
    rnd = random.Random(7)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for _ in range(5000):
            t = "\n".join(rnd.choice(PIECES) for _ in range(rnd.choice([1, 2, 3, 4, 6]))) + rnd.choice(["", "\n"])
            assert imports._of_code(t) == whole(t), t


def test_plain_statements_are_not_parsed(monkeypatch):
    """Trees of large programs took 3.5 seconds for each MB of words."""
    monkeypatch.setattr(imports.ast, "parse", lambda x: 1 / 0)
    assert imports._of_code('import a.sub as x\ndef f():\n    from b.c import (d,\n        e)\ns = """\nimport no\n"""\nfrom g import h') == ["a", "g", "b"]


def test_code_is_parsed_once(spark, monkeypatch):
    """Names looked up in a large list are counted first and then joined; the plan has no more parsing for either."""
    monkeypatch.setattr(classify, "BROADCAST_BYTES", 0)
    code = spark.createDataFrame([(1, "import a, b\nimport c_d"), (2, "import b"), (3, None)], "id int, t string")
    x = classify.classify_imports(code.select("id", imports.top_level_imports(F.col("t")).alias("m")), "id", "m", spark.createDataFrame([("b",), ("c-d",)], "name string"), standard=[]).drop("m")
    assert "EvalPython" not in x._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.import_valid, r.import_hallucinated) for r in x.collect()) == [(1, ["b", "c_d"], ["a"]), (2, ["b"], []), (3, [], [])]


def test_large_lists_have_what_small_ones_have(spark, monkeypatch):
    """Hot names, aliases, known false positives and modules without a name, by each of the three ways."""
    mods = [(i, ["hot", "cv2", "a_b", "false", "", None, f"m{i % 7}", "std", "hot"]) for i in range(300)] + [(900, None), (901, [])]
    df, names = spark.createDataFrame(mods, "id int, m array<string>"), spark.createDataFrame([("hot",), ("opencv-python",), ("m3",), ("a-b",)], "name string")
    wrong, out = spark.createDataFrame([("false",), ("hot",)], "name string"), []
    for small in (lambda d: True, lambda d: d.columns == ["l_name", "is_valid"], lambda d: False):
        monkeypatch.setattr(classify, "_small", small)
        for f in (None, wrong):
            out.append(sorted(tuple(r) for r in classify.classify_imports(df, "id", "m", names, f, ["std"]).drop("m").collect()))
    assert out[0] == out[2] == out[4] and out[1] == out[3] == out[5]
    assert out[0][3] == (3, ["hot", "cv2", "a_b", "m3"], ["false"]) and out[1][4] == (4, ["hot", "cv2", "a_b"], ["m4"])
