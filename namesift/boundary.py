"""What stands outside the engine: tokenizers, generators, scorers. Small protocols with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Tokens whose ids a batch keeps at hand.
KNOWN = 500_000


class Tokenizer(Protocol):
    eos: int

    def tokens(self, text: Column) -> Column:
        """An array of (id, s, e): token ids with code-point offsets."""


class WordTokenizer:
    """Words and single signs; ids are the first 24 bits of the md5 of a token, past the special ids."""

    PATTERN = r"\w+|[^\w\s]"
    pad, eos, first = 0, 1, 2

    def __init__(self) -> None:
        pattern, first = re.compile(self.PATTERN), self.first

        @F.arrow_udf(ArrayType(StructType([StructField(c, IntegerType()) for c in ("id", "s", "e")])))
        def run(texts: pa.Array) -> pa.Array:
            """Numbers of all tokens lie in three flat arrays; no token is a Python object of its own for long."""
            seen: dict[str, int] = {}
            flat, ends = (array("i"), array("i"), array("i")), array("i", [0])

            def of(token: str) -> int:
                if token not in seen:
                    if len(seen) >= KNOWN:
                        seen.clear()
                    seen[token] = first + int(hashlib.md5(token.encode()).hexdigest()[:6], 16)
                return seen[token]

            for t in texts:
                for m in pattern.finditer(t.as_py() or ""):
                    for column, x in zip(flat, (of(m.group()), m.start(), m.end()), strict=True):
                        column.append(x)
                ends.append(len(flat[0]))
            columns = [pa.array(np.frombuffer(c, np.int32) if len(c) else np.empty(0, np.int32)) for c in flat]
            return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.StructArray.from_arrays(columns, ["id", "s", "e"]))

        self._run = run

    def tokens(self, text: Column) -> Column:
        return self._run(text)


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class EchoGenerator:
    """A stand-in that answers with the words of the prompt that look like names, at most `n`."""

    def __init__(self, n: int = 5):
        self.n = n

    def generate(self, prompts: list[str]) -> list[str]:
        return [", ".join(dict.fromkeys(re.findall(r"[A-Za-z][\w-]{3,}", p or ""))) if self.n < 0 else ", ".join(list(dict.fromkeys(re.findall(r"[A-Za-z][\w-]{3,}", p or "")))[: self.n]) for p in prompts]


def generate(df: DataFrame, generator: Generator, prompt: str, out: str = "response", batch: int = 16) -> DataFrame:
    """df with a generator's answer to each row's prompt, batch by batch."""
    schema = df.withColumn(out, F.lit(None).cast("string")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, answers = pdf[prompt].tolist(), []
            for i in range(0, len(texts), batch):
                answers += generator.generate(texts[i : i + batch])
            yield pdf.assign(**{out: answers})

    return df.mapInPandas(run, schema)


def pending(prompts: DataFrame, done: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that have no answer yet: where a run that broke off goes on."""
    return prompts.join(done.select(key), key, "left_anti")


def score_pairs(df: DataFrame, score: Callable[[list[str], list[str]], list[float]], question: str = "question", matching: str = "answer_matching_behavior", other: str = "answer_not_matching_behavior") -> DataFrame:
    """df with matching_score and not_matching_score, the mean token log-probabilities that a scorer gives each answer."""
    schema = df.withColumns({"matching_score": F.lit(0.0), "not_matching_score": F.lit(0.0)}).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            q = pdf[question].tolist()
            yield pdf.assign(matching_score=score(q, pdf[matching].tolist()), not_matching_score=score(q, pdf[other].tolist()))

    return df.mapInPandas(run, schema)
