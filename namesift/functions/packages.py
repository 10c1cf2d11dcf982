"""Package names in free text: code blocks, prose, loops, lists, cleaning, and the gate that rejects prose.

Each stage is a Column of its own. extract_packages() runs them as a few projections, so that no stage's text is
computed more than once.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from namesift.functions import lists
from namesift.functions.finding import listed
from namesift.functions.text import SPACE, normalize_python_package, strip

#: Markers of prose, in order of priority.
PROSE = ("Explanation:", "Note:", "Please note", "Important:", "Additional notes:")
#: Cue phrases of a cut-off answer.
CUT_OFF = ("This command", "Here is an example", "You can install")
#: Words after a numbered name that make its line a description.
DESCRIBED = r"\bfrom\b|\bclass\b|\bfunction\b|\bdefined in\b|\(defined"
#: Endings of variable names.
VARIABLE = r"(?iU)^.*_(string|data|input|output|result|value|text|file|path|name|var|obj|object|item|list|dict|array|buffer|stream|content|response|request|str|num|int|float|id|idx|key|val|ptr|ref|temp|tmp|flag|bool|char|byte)s?$"


@dataclass(frozen=True)
class Words:
    """Word lists of the token cleaner. The list of words that are never names is long and must be given, see load()."""

    delete: frozenset[str]
    #: Fixed values from here on.
    frameworks: tuple[str, ...] = ("django", "flask", "elastic", "apm", "new", "vmware", "rest", "framework")
    legitimate: tuple[str, ...] = ("requests", "responses", "attrs", "datasets", "datatable")
    prefixes: tuple[str, ...] = ("print", "get", "set", "read", "write", "load", "save", "fetch", "send", "receive")
    parts: tuple[str, ...] = field(default=("contrib", "instrumentation", "config"))

    @classmethod
    def load(cls, path: str) -> Words:
        """From a JSON object with the lists delete, frameworks, legitimate_packages and func_prefixes."""
        with open(path, encoding="utf-8") as f:
            x = json.load(f)
        return cls(frozenset(x["delete"]), tuple(x["frameworks"]), tuple(x["legitimate_packages"]), tuple(x["func_prefixes"]))


def strip_code_blocks(t: Column) -> Column:
    """Closed fences become a line feed, an open one cuts the rest off, inline code over several lines goes; install commands stay at the end."""
    pips = F.regexp_extract_all(t, F.lit(r"(?iuU)pip\s+install\s+[^\n]+"), F.lit(0))
    closed = F.regexp_replace(t, r"(?sU)```\w*\n.*?\n```", "\n")
    cut = F.when(closed.rlike(r"(?U)```\w*\n"), F.substring_index(closed, "```", 1)).otherwise(closed)
    inline = F.regexp_replace(cut, r"(?sU)`[^`\n]*\n(?:(?!\d+[.)]\s)[^`])*`", "\n")
    return F.when(F.size(pips) > 0, F.concat(inline, F.lit("\n"), F.array_join(pips, "\n"))).otherwise(inline)


def prose_cut(t: Column) -> Column:
    """The text before the marker of prose that comes first in PROSE, not in the text."""
    out = t
    for m in reversed(PROSE):
        pattern = rf"(?iuU)\b{m}"
        at = F.regexp_instr(t, F.lit(pattern))
        out = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(out)
    return out


def _may_be_digit(x: Column) -> Column:
    """Whether a text's first sign is a digit, or one beyond ASCII, which may be one."""
    code = F.ascii(x)
    return code.between(48, 57) | (code > 127)


def _bare(line: Column) -> Column:
    # few lines begin with a number, so few meet the pattern
    return strip(F.when(_may_be_digit(strip(line)), F.regexp_replace(line, r"(?U)^\s*\d+[.)]\s*", "")).otherwise(line))


def loop_start(t: Column) -> Column:
    """Where the second of at least three equal cycles of 3 to 20 lines from the start begins, in characters; 0 without a loop.

    Three repeats of a cycle c are there exactly when lines 1 to 2c equal lines c+1 to 3c.
    """
    def first_cycle(full: Column) -> Column:
        n = F.size(full)
        cycles = F.when(n >= 9, F.sequence(F.lit(3), F.least(F.lit(20), F.floor(n / 3)).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.get(F.filter(cycles, lambda c: F.slice(full, F.lit(1), 2 * c) == F.slice(full, c + 1, 2 * c)), F.lit(0))

    def walk(s: Column) -> Column:
        """Characters up to the end of the first cycle."""
        seen = lambda a, x: a["seen"] + F.when(_bare(x) != "", 1).otherwise(0)
        return F.aggregate(
            s["l"], F.struct(F.lit(0).alias("at"), F.lit(0).alias("seen")),
            lambda a, x: F.when(a["seen"] >= s["c"], a).otherwise(F.struct((a["at"] + F.length(x) + 1).alias("at"), seen(a, x).alias("seen"))), lambda a: a["at"],
        )

    # lines, what is left of them and the cycle as variables of lambdas, so that each is made once
    one = F.transform(F.array(F.split(t, "\n", -1)), lambda lines: F.struct(lines.alias("l"), F.filter(F.transform(lines, _bare), lambda x: x != "").alias("f")))
    cycled = F.filter(F.transform(one, lambda s: F.struct(s["l"].alias("l"), first_cycle(s["f"]).alias("c"))), lambda s: s["c"].isNotNull())
    return F.coalesce(F.get(F.transform(cycled, walk), F.lit(0)), F.lit(0))


def cut_loop(t: Column) -> Column:
    at = loop_start(t)
    return F.when(at > 0, F.substring(t, F.lit(1), at)).otherwise(t)


@F.pandas_udf(ArrayType(StringType()))
def _listed(texts: pd.Series) -> pd.Series:
    described = re.compile(DESCRIBED, re.IGNORECASE)
    return texts.map(lambda t: None if t is None else listed(t, described))


def numbered(t: Column) -> Column:
    """Names of a numbered list, without those whose line describes them; null where fewer than two are left. One pass over the text, however long the list."""
    return _listed(t)


def free_form(t: Column) -> Column:
    """Parts of a text divided at commas, line ends (also written out) and around quoted names."""
    x = F.regexp_replace(t, r"```[a-z]*\n?", "")
    for pattern, to in ((r"(?U)\\n\d+\.", ","), (r"\\n", ","), (r"(?U)\n\d+\.", ","), (r"\n", ","), (r"`([a-zA-Z0-9\-_.]+)`", ",$1,"), (r"'([a-zA-Z0-9\-_.]+)'", ",$1,")):
        x = F.regexp_replace(x, pattern, to)
    return F.split(x, ",", -1)


def _tokens(parts: Column) -> Column:
    """Each part's first word without what stands around names; most are a bare word once trimmed."""
    return F.transform(F.transform(parts, lambda part: F.btrim(strip(part), F.lit(".,;:!?'\"()[]{}"))), _token)


def _token(x: Column) -> Column:
    return F.when(x.rlike("^[a-zA-Z_][a-zA-Z0-9_.-]*$"), x).otherwise(_first_word(x))


def _first_word(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)^[-*]\s*", ""), r"(?U)^\d+[.)]\s*", "")
    x = F.replace(F.replace(x, F.lit(" and "), F.lit(" ")), F.lit(" or "), F.lit(" "))
    return F.regexp_replace(F.regexp_extract(x, rf"(?s)^{SPACE}*([^{SPACE[1:]}+)", 1), r"[^a-zA-Z0-9\-_.]", "")


def clean_tokens(parts: Column, words: Words) -> Column:
    """The names in the parts of an array, each made once before it is judged."""
    return F.array_compact(F.transform(_tokens(parts), lambda x: _name(x, words)))


def clean_token(part: Column, words: Words) -> Column:
    """The name in one part; null where there is none."""
    return F.get(clean_tokens(F.array(part), words), F.lit(0))


def _name(x: Column, words: Words) -> Column:
    low, dots = F.lower(x), F.length(x) - F.length(F.replace(x, F.lit("."), F.lit("")))
    drop = (F.length(x) <= 2) | x.rlike(r"^[0-9]+$") | (dots >= 2)
    if words.delete:
        drop |= low.isin(*sorted(words.delete))
    drop |= low.isin(*words.frameworks) & ~x.contains("-")
    drop |= (dots == 1) & F.exists(F.split(low, r"\."), lambda p: p.isin(*words.parts))
    prefix = F.lit(False)
    for p in words.prefixes:
        prefix |= low.startswith(p) & (F.length(x) > len(p))
    drop |= ~low.isin(*words.legitimate) & (x.rlike(VARIABLE) | prefix | x.endswith("_") | x.endswith("."))
    return F.when(~drop, x)


def rejected(t: Column) -> Column:
    """Whether a text without any structure is too long, mostly prose, or cut off."""
    commas, periods = (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in ",.")
    structure = t.contains("`") | t.rlike(r"(?U)(\n|^)\s*\d+[.)]\s+") | t.rlike(r"(?U)(\n|^)\s*[-*]\s+") | ((commas >= 1) & (periods < F.floor(commas / 2) + 1))
    cue = F.lit(False)
    for c in CUT_OFF:
        cue |= t.contains(c)
    return ~structure & ((F.length(t) >= 2000) | ((periods > 2 * commas) & (periods > 10)) | (cue & ~strip(t).rlike("[.!?`]$")))


def extract_packages(df: DataFrame, text: str, out: str, words: Words, loops: bool = True) -> DataFrame:
    """df with the normalised names in a text column, in order and without repeats; none for null."""
    t = f"__{out}_t"
    # generators, so that each step is made once for each row and not again in each expression over it
    once = lambda x, name, c: x.withColumn(name, F.explode(F.array(c)))
    x = once(df, t, prose_cut(strip_code_blocks(F.coalesce(F.col(text), F.lit("")))))
    if loops:
        x = once(x, t, F.when(F.length(t) > 0, cut_loop(F.col(t))).otherwise(""))
    x = once(x, f"{t}p", F.coalesce(numbered(F.col(t)), free_form(F.col(t))))
    # a part's name depends on the part alone, so equal parts are judged once
    x = once(x, f"{t}p", clean_tokens(F.array_distinct(f"{t}p"), words))
    names = lists.ordered_distinct(F.transform(f"{t}p", normalize_python_package))
    return x.withColumn(out, F.when(rejected(F.col(t)), lists.empty()).otherwise(names)).drop(t, f"{t}p")


def parse_pip_install(t: Column, all_args: bool = False) -> Column:
    """The word after each install command, unless it is an option; all_args takes every word of the command."""
    if all_args:
        commands = F.regexp_extract_all(t, F.lit(r"(?U)pip[^\S\n]+install[^\S\n]+([^\n]*)"), F.lit(1))
        found = F.flatten(F.transform(commands, lambda c: F.split(strip(c), r"\s+")))
    else:
        found = F.regexp_extract_all(t, F.lit(r"(?U)pip\s+install\s+(\S+)"), F.lit(1))
    return F.coalesce(F.filter(found, lambda x: ~x.startswith("-") & (x != "")), lists.empty())


def clean_pips(items: Column) -> Column:
    """Install arguments as names: brackets go, arguments with signs of paths, URLs or markers are left out, versions are cut off."""
    bare = F.transform(items, lambda x: F.translate(x, "()[]`", ""))
    fit = F.filter(bare, lambda x: ~x.rlike(r"[+@:\"',{}/*]"))
    parts = F.filter(F.flatten(F.transform(fit, lambda x: F.split(strip(x), r"(?U)\s+"))), lambda p: ~p.startswith("--") & (p != ""))
    names = F.transform(F.filter(parts, lambda p: ~p.rlike("^[=<>!~]")), lambda p: normalize_python_package(strip(F.regexp_extract(p, "^([^=<>!~]+)", 1))))
    return F.filter(names, lambda n: ~n.startswith("--") & ~n.contains("requirements"))


def split_legacy(t: Column, style: str | None = None, pre: bool = False, post: bool = False) -> Column:
    """The older parser: parts between commas that are one word, with a model family's steps before and after."""
    parts = F.split(before(t, style) if pre and style else t, ",", -1)
    from namesift.functions.text import normalize_python_legacy

    one = F.filter(F.transform(parts, normalize_python_legacy), lambda x: strip(x).rlike(r"^[^\s]+$"))
    return lists.distinct_longer(F.transform(one, lambda x: after(x, style)) if post and style else one)


def before(t: Column, style: str) -> Column:
    """A family's repair of line ends that are written out, and of quoted names."""
    ends = {"WizardCoder": r"\\r\\n-|\\r\\n\d\.|\\r\\n", "DeepSeek": r"\\n|\\n\d\.", "Mistral": r"\\n|\\n\d\.", "CodeLlama": r"\\n"}
    if style not in ends:
        return t
    x = F.regexp_replace(t, "(?U)" + ends[style], ",")
    return x if style == "CodeLlama" else F.regexp_replace(x, r"(?U)`(\w+)`", ",$1,")


#: Signs that go, and words that are no names, by family.
_AFTER = {
    "WizardCoder": (r"[()'\"]", ("and", "the", "optional", "it'")),
    "DeepSeek": (r"[:\"'()]", ("and", "the", "optional", "it'")),
    "CodeLlama": (r"\":\(", ("python", "nan")),
    "Mistral": (r"[:()]|```", ("run", "with", "additionally", "the", "and", "bash", "pip", "make", "module", "package", "import-module", "using", "however", "python", "for")),
}


def after(name: Column, style: str) -> Column:
    """A name without a family's signs; empty for its stop words."""
    if style == "Openchat":
        x = F.regexp_replace(F.replace(name, F.lit("gpt4"), F.lit("")), "g{3,}", "")
        return F.when(x.rlike("git|gpt"), "").otherwise(x)
    if style not in _AFTER:
        return name
    signs, stop = _AFTER[style]
    x = F.regexp_replace(name, signs, "")
    return F.when(x.isin(*stop), "").otherwise(x)


def steps_for(model: str, language: str) -> tuple[bool, bool, str]:
    """(repair before, repair after, family) for a model's answers."""
    python = language == "Python"
    if model == "CodeLlama_34B_Python":
        return False, False, "CodeLlama"
    if model in ("Mistral_7B", "Mixtral_7B"):
        return python, python, "Mistral"
    if "deep" in model or "Deep" in model:
        if language == "Javascript":
            return False, False, model if model in ("DeepSeek_1B", "DeepSeek_6B", "DeepSeek_33B") else ""
        return True, True, "DeepSeek"
    if model in ("WizardCoder_33B", "WizardCoder_Python_7B"):
        return python, python, "WizardCoder"
    return (False, python, "Openchat") if model == "Openchat_7B" else (False, False, "")
