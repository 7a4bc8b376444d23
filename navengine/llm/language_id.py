"""Language identification with word-first backoff.

A word that the model knows is scored by its log frequency in each language. An
unseen word falls back to its character 4-grams, then to 3-, 2- and
1-grams: the longest length of which any n-gram is known gives the mean of
their log frequencies. A text's language is the one with the largest sum.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .folds import held_out, sample_per_class

UNDETERMINED = "und"
LENGTHS = (4, 3, 2, 1)
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ngrams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between two boundary marks (1-grams without them)."""
    s = f"^{word}$" if n > 1 else word
    return [s[i : i + n] for i in range(len(s) - n + 1)]


@dataclass
class LanguageModel:
    """known: word to row; grams: n-gram to row; rows: log frequency by language, then prior."""

    languages: list[str]
    known: dict[str, int]
    grams: dict[str, int]
    rows: np.ndarray
    prior: np.ndarray


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 1500, alpha: float = 0.2) -> LanguageModel:
    """Fit on about ``rows_per_language`` rows of each language.

    The model keeps all words and n-grams of the sample, so the sample bounds what is collected and broadcast. A language's prior is
    its share of all labelled rows, however many are sampled.
    Rows with a null text or language are left out; without rows the model knows no language.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sample = sample_per_class(rows, "lang", "id", rows_per_language)
    of_all = {r["lang"]: r["count"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).count().collect()}  # a row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words(t))
            out: Counter = Counter()
            for lang, c in seen.items():
                for w, k in c.items():
                    out[lang, 0, w] += k
                    for n in LENGTHS:
                        for g in ngrams(w, n):
                            out[lang, n, g] += k
            keys = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(out.values()), pa.int64())], names=["lang", "n", "item", "k"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, n int, item string, k bigint").groupBy("lang", "n", "item").agg(F.sum("k").alias("k"))
    top = counts.toArrow()
    top = [dict(zip(top.column_names, r, strict=True)) for r in zip(*(c.to_pylist() for c in top.columns), strict=True)]
    langs = sorted({r["lang"] for r in top})
    place = {x: i for i, x in enumerate(langs)}
    totals = np.zeros((5, len(langs)))
    known: dict[str, int] = {}
    grams: dict[str, int] = {}
    for r in top:
        totals[r["n"], place[r["lang"]]] += r["k"]
        d = known if r["n"] == 0 else grams
        d.setdefault(r["item"], 0)
    index = {("w", w): i for i, w in enumerate(sorted(known))} | {("g", g): len(known) + i for i, g in enumerate(sorted(grams))}
    k = np.zeros((len(index), len(langs)))
    kind = np.zeros(len(index), int)
    for r in top:
        i = index["w" if r["n"] == 0 else "g", r["item"]]
        k[i, place[r["lang"]]] = r["k"]
        kind[i] = r["n"]
    logs = np.log((k + alpha) / (totals[kind] + alpha * max(1, len(index)))) if langs else np.zeros((0, 0))
    size = np.array([of_all[x] for x in langs], float)
    size = size / size.sum()
    return LanguageModel(langs, {w: index["w", w] for w in known}, {g: index["g", g] for g in grams}, logs, np.log(size))


class Scorer:
    """Scores texts with a model; rows of unseen words are kept up to a bound."""

    def __init__(self, model: LanguageModel, most_kept: int = 400_000):
        self.m, self.most = model, most_kept
        self.reset()

    def reset(self) -> None:
        m = self.m
        self.place = dict(m.known)
        self.rows = np.zeros((len(m.rows) + self.most, len(m.languages)), np.float32)
        self.rows[: len(m.rows)] = m.rows
        self.used = len(m.rows)

    def unseen(self, word: str) -> int:
        grams = self.m.grams
        for n in LENGTHS:
            at = [grams[g] for g in ngrams(word, n) if g in grams]
            if at:
                self.rows[self.used] = self.m.rows[at].mean(axis=0)
                break
        self.place[word] = self.used
        self.used += 1
        return self.used - 1

    def score(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words(text)) if text else {}
        if not any(any(map(str.isalpha, w)) for w in counts) or not self.m.languages:
            return UNDETERMINED, 0.0
        if self.used + len(counts) > len(self.rows):
            self.reset()
            if self.used + len(counts) > len(self.rows):  # one very long text
                self.rows = np.concatenate((self.rows, np.zeros((len(counts), self.rows.shape[1]), np.float32)))
        place = self.place
        at = [i if (i := place.get(w)) is not None else self.unseen(w) for w in counts]
        total = np.fromiter(counts.values(), np.float64, len(counts)) @ self.rows[at] + self.m.prior
        best = int(total.argmax())
        return self.m.languages[best], 1.0 / math.fsum(np.exp(total - total[best]))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score.

    A null text, a text without letters, and any text under a model without
    languages get ``und`` and 0. Ties go to the language first in order. Whole texts are read, however long;
    all rows, repeated ones too, and all columns stay (a former lang_pred or score is replaced).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in texts:
            yield pd.DataFrame([scorer.score(t) for t in batch], columns=["lang", "score"])

    out = docs.drop("lang_pred", "score").withColumn("__nav_found", found(F.col(text_col).cast("string")))
    return out.withColumns({"lang_pred": F.col("__nav_found.lang"), "score": F.col("__nav_found.score")}).drop("__nav_found")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
