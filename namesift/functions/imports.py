"""Top-level modules of Python code."""

from __future__ import annotations

import ast
import keyword
import re
import sys
from collections.abc import Iterator
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Modules whose package has another name.
ALIASES = {
    "sklearn": "scikit-learn",
    "cv2": "opencv-python",
    "pil": "pillow",
    "yaml": "pyyaml",
    "bs4": "beautifulsoup4",
    "dotenv": "python-dotenv",
    "google": "google-api-python-client",
    "attr": "attrs",
    "dateutil": "python-dateutil",
    "jwt": "pyjwt",
    "docx": "python-docx",
    "pptx": "python-pptx",
    "requests_oauthlib": "requests-oauthlib",
    "serial": "pyserial",
    "usb": "pyusb",
    "OpenSSL": "pyopenssl",
    "Crypto": "pycryptodome",
    "nacl": "pynacl",
    "markdown_it": "markdown-it-py",
}
#: A statement's module, by line.
IMPORT, FROM = r"(?U)^import\s+([a-zA-Z_]\w*)", r"(?U)^from\s+([a-zA-Z_]\w*)[\w.]*\s+import\s"


def standard_modules() -> list[str]:
    """Modules of the driver's Python."""
    return sorted(sys.stdlib_module_names)


def imports_by_line(code: Column) -> Column:
    """Modules by the import statements of each line, for code that does not parse: the first of a line."""
    lines = F.transform(F.split(code, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    taken = lambda x, pattern: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))
    return F.array_compact(F.transform(lines, lambda x: F.coalesce(taken(x, IMPORT), taken(x, FROM))))


def _modules(node: ast.AST) -> Iterator[str]:
    """First components of what a statement imports from elsewhere."""
    match node:
        case ast.Import(names=names):
            yield from (a.name.partition(".")[0] for a in names)
        case ast.ImportFrom(module=str(module), level=0 | None) if module:
            yield module.partition(".")[0]


def _statements() -> tuple[re.Pattern, re.Pattern]:
    """(statements that a pattern knows whole, or else lines; import statements in the body of a function).

    Known are imports, text in triple quotes given to a name and functions of no arguments that only import, from a
    line's begin to its end. Names in other letters than ASCII and other white space are left to the parser.
    """
    name = rf"(?!(?:{'|'.join(keyword.kwlist)})\b)[A-Za-z_][A-Za-z_0-9]*"
    dotted, as_, end = rf"{name}(?:\.{name})*", rf"(?: +as +{name})?", r" *(?:\n|\Z)"
    item, each = rf"{name}{as_}", rf"{dotted}{as_}"
    wrapped = rf"\([ \n]*{name}(?:[ \n]+as[ \n]+{name})?(?:[ \n]*,[ \n]*{name}(?:[ \n]+as[ \n]+{name})?)*[ \n]*(?:,[ \n]*)?\)"
    from_ = rf"from +({dotted}) +import *(?:{wrapped}|(?<= ){item}(?: *, *{item})*|\*)"
    import_ = rf"import +({each}(?: *, *{each})*)"
    inner = re.sub(r"\((?=[^?])", "(?:", f"{import_}|{from_}".replace(r"\(", "\0")).replace("\0", r"\(")
    body = rf"def +{name}\(\): *\n((?P<indent> +)(?:{inner}){end}(?:(?P=indent)(?:{inner}){end})*)"
    text = rf'{name} *= *"""[^"\\\0\r]*"""'
    return re.compile(rf"(?:{import_}|{from_}|{text}){end}|{body}|([^\n]+\n?|\n)"), re.compile(rf" *(?:{import_}|{from_}){end}")


STATEMENT, INNER = _statements()


def _by_depth(tree: ast.AST) -> Iterator[list[str]]:
    """Modules imported at each depth of a tree. Statements stand in lists of statements, handlers and cases alone."""
    level = tree.body
    while level:
        yield list(chain.from_iterable(map(_modules, level)))
        level = [x for node in level for f in ("body", "handlers", "orelse", "finalbody", "cases") if isinstance(below := getattr(node, f, None), list) for x in below]


def _listed(names: str) -> Iterator[str]:
    """First components of the names after an import."""
    return (x.partition(".")[0].split()[0] for x in names.split(","))


def _of_code(text: str) -> list[str] | None:
    """What the tree of the whole text has, by depths.

    Statements that a pattern knows are read by it. The lines between them are parsed by themselves: if each run of lines
    is a program, then so is all of it, with the statements of them all; if one is not, all is parsed at once.
    """
    try:
        if "__future__" not in text:  # it changes how what follows is parsed
            try:
                return _by_parts(text)
            except (SyntaxError, ValueError, RecursionError, MemoryError, TypeError):
                pass
        return list(chain.from_iterable(_by_depth(ast.parse(text))))
    except (SyntaxError, ValueError, RecursionError, MemoryError, TypeError):
        return None


def _by_parts(text: str) -> list[str]:
    depths: list[list[str]] = [[], []]
    top, nested = depths
    for known, found in groupby(STATEMENT.findall(text), lambda x: not x[4]):
        if known:
            for names, module, body, _, _ in found:
                if module:
                    top.append(module.partition(".")[0])
                elif names:
                    top.extend(_listed(names))
                elif body:
                    for more, other in INNER.findall(body):
                        nested.extend(_listed(more) if more else (other.partition(".")[0],))
        elif not (lines := "".join(x[4] for x in found)).isspace():
            for i, x in enumerate(_by_depth(ast.parse(lines))):
                if i == len(depths):
                    depths.append([])
                depths[i].extend(x)
    return list(chain.from_iterable(depths))


@F.pandas_udf(ArrayType(StringType()))
def _parsed(code: pd.Series) -> pd.Series:
    """Modules by the syntax tree; null for code that does not parse. The tree has no counterpart among Spark's functions."""
    return code.map(_of_code)


def top_level_imports(code: Column) -> Column:
    """Modules in the order the syntax tree meets them; by lines where the code does not parse; none for null."""
    c = F.coalesce(code, F.lit(""))
    # only code that can hold an import crosses over to Python
    return F.when(~c.rlike("import"), F.array().cast("array<string>")).otherwise(F.coalesce(_parsed(c), imports_by_line(c)))
