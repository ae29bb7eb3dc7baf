"""Plug-in points for models: encoders, scorers and text generators, with deterministic stand-ins.

A plug-in is built once per Python worker (``factory()``) and called on Arrow batches, so a model is loaded once per worker, not per row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as T

Encoder = Callable[[list[str]], np.ndarray]
Generator = Callable[[list[str]], list[str | None]]
PairScorer = Callable[[list[tuple[str, str]]], list[float]]


def hashing_encoder(dim: int = 64) -> Callable[[], Encoder]:
    """Signed feature hashing of lower-case words, L2-normalised: the stand-in for a neural encoder."""

    def factory() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1 if h & (1 << 20) else -1
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm > 0, norm, 1)

        return encode

    return factory


def encode(df: DataFrame, text: str, out: str, factory: Callable[[], Encoder]) -> DataFrame:
    """``df`` with vectors of ``text``; null texts are encoded as empty ones."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            yield pd.Series(list(model([t if isinstance(t, str) else "" for t in batch])), dtype=object)

    return df.withColumn(out, run(F.col(text)))


def score_pairs(pairs: DataFrame, factory: Callable[[], PairScorer], head: str = "raw") -> DataFrame:
    """``new_score`` of ``query_text, doc_text``; heads: raw, or sigmoid of a logit. A failing scorer fails the task: no score is invented."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for q, d in batches:
            yield pd.Series(model(list(zip(q, d))), dtype="float64")

    z = run(F.col("query_text"), F.col("doc_text"))
    return pairs.withColumn("new_score", z if head == "raw" else 1 / (1 + F.exp(-z)))


def check_scorer(model: PairScorer, query: str, relevant: str, other: str, least: float = 0.05) -> bool:
    """Whether a scorer tells a relevant from an irrelevant pair."""
    a, b = model([(query, relevant), (query, other)])
    return a - b >= least


def generate(
    df: DataFrame, text: str, out: str, factory: Callable[[], Generator], fallback: Column, valid: Callable[[Column], Column], check: Callable[[str], str | None] | None = None, attempts: int = 3
) -> DataFrame:
    """Generated texts, with the rule-based ``fallback`` where the generator gives nothing valid.

    ``check`` tells what is wrong with an answer (None: nothing); such texts are asked for again, in one batch, with that said behind them, ``attempts`` times in all.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            asked = [t if isinstance(t, str) else "" for t in batch]
            answers = model(asked)
            for _ in range(attempts - 1 if check else 0):
                wrong = [(i, said) for i, a in enumerate(answers) if (said := "no answer" if a is None else check(a))]
                if not wrong:
                    break
                for (i, _), again in zip(wrong, model([f"{asked[i]}\n\nThe answer before was not valid: {said}" for i, said in wrong])):
                    answers[i] = again
            yield pd.Series([None if a is None or (check and check(a)) else a for a in answers], dtype=object)

    made = df.withColumn("__made", run(F.col(text)))
    return made.withColumn(out, F.when(F.coalesce(valid(F.col("__made")), F.lit(False)), F.col("__made")).otherwise(fallback)).drop("__made")


def translate_missing(rows: DataFrame, cache: DataFrame, factory: Callable[[], Generator]) -> DataFrame:
    """``src, dst``: cached translations, the generator's cleaned ones for misses; identical and null results drop out."""
    wanted = rows.select("src").distinct()
    missing = generate(wanted.join(cache, "src", "left_anti"), "src", "dst", factory, F.lit(None).cast("string"), lambda c: F.trim(c) != "")
    found = missing.select("src", T.clean_translation("dst").alias("dst")).unionByName(wanted.join(cache.select("src", "dst"), "src"))
    return found.filter("dst IS NOT NULL AND dst != src").distinct()


def keywords(x: str | Column, n: int = 12) -> Column:
    """Noun-like keywords without a tagger: salient distinct words of a text."""
    tokens = F.regexp_extract_all(F.col(x) if isinstance(x, str) else x, F.lit(r"[A-Za-z][A-Za-z0-9\-]{3,}"), F.lit(0))
    stop = T.stop_array()
    return T.salient_terms(F.filter(tokens, lambda t: ~F.array_contains(stop, F.lower(t))), n)
