"""Toxicity: a weighted lexicon, learned from labels and matched by Aho-Corasick on folded text.

Folding undoes homoglyphs, full-width forms, zero-width characters and digits that stand for letters. A pattern is
a whole word or the beginning of one; its weight is the log odds of its document counts in toxic and clean training
documents. Phrases around a lexicon word that clean documents use and toxic ones do not are exceptions: a match
inside one does not count. The weights found are normalised by the text's length and turned into a probability by
a logistic curve fitted on the same rows.

Defined cases: null and empty texts have no match and get the score of a text without matches; repeated rows each
get their score; without both kinds of training rows every score is the share of toxic ones (0 without any).
Scores depend on the text alone, so extra columns, and nulls in them, play no part.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.components import written

#: The classifier is fitted on so many labelled rows at most, chosen by the hash of their id.
TRAINING_ROWS = 20_000
MAX_PATTERNS = 20_000
MAX_EXCEPTIONS = 5_000
MIN_DOCUMENTS = 3
THRESHOLD = 0.7
PRIOR_WORDS = 20

_LOOKALIKES = str.maketrans(
    "авекмнорстухіјѕԁԛԝαειοκνρτυχ", "abekmhopctyxijsdqwaeioknptux", "­​‌‍⁠﻿"
)
_DIGITS = str.maketrans("013457@$", "oieastas")
_STANDING_FOR_LETTERS = re.compile(r"[013457@$]+(?=[^\W\d_])|(?<=[^\W\d_])[013457@$]+(?=[^\W\d_])|(?<=[^\W\d_])[013457]+(?!\w)")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> list[str]:
    """The words of a text, lower-cased, with look-alike characters and digits turned into letters."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(_LOOKALIKES)
    if any(c in text for c in "013457@$"):
        text = _STANDING_FOR_LETTERS.sub(lambda found: found[0].translate(_DIGITS), text)
    return _WORD.findall(text)


def patterns_of(word: str) -> list[str]:
    """`` word `` for the whole word and `` wor`` for its beginnings of 3 to 9 letters."""
    return [f" {word} ", *(f" {word[:n]}" for n in range(3, min(len(word), 9) + 1))]


@dataclass
class Model:
    """What is learned: bounded by MAX_PATTERNS, MAX_EXCEPTIONS and a handful of numbers."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    mean: list[float] = field(default_factory=lambda: [0.0] * 4)
    scale: list[float] = field(default_factory=lambda: [1.0] * 4)
    coefficients: list[float] = field(default_factory=lambda: [-math.inf] + [0.0] * 4)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_machine"}

    def machine(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        if "_machine" not in self.__dict__:
            machine = ahocorasick.Automaton()
            for pattern, weight in self.weights.items():
                machine.add_word(pattern, (len(pattern), weight))
            machine.make_automaton()
            self._machine = machine
        return self._machine

    def matches(self, words: list[str]) -> dict[int, float]:
        """The greatest weight at the beginning of each word that matches, by its place in the joined text."""
        machine, best = self.machine(), {}
        if machine is not None and words:
            for end, (length, weight) in machine.iter(f" {' '.join(words)} "):
                at = end - length + 1
                if weight > best.get(at, 0.0):
                    best[at] = weight
        return best

    def hits(self, words: list[str]) -> list[tuple[float, str, str]]:
        """Weight and the two phrases (with the word before, with the word after) of every match."""
        best = self.matches(words)
        if not best:
            return []
        places = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
        out = []
        for at, weight in best.items():
            i = int(np.searchsorted(places, at))
            before = f"{words[i - 1]} {words[i]}" if i else ""
            after = f"{words[i]} {words[i + 1]}" if i + 1 < len(words) else ""
            out.append((weight, before, after))
        return out

    def features(self, words: list[str]) -> list[float]:
        found = [w for w, before, after in self.hits(words) if before not in self.exceptions and after not in self.exceptions]
        total, length = math.fsum(found), len(words) + PRIOR_WORDS
        return [100 * total / length, math.log1p(total), max(found, default=0.0), 100 * len(found) / length]

    def score(self, text: str | None) -> float:
        z = self.coefficients[0]
        for value, mean, scale, weight in zip(
            self.features(fold(text)), self.mean, self.scale, self.coefficients[1:], strict=True
        ):
            z += weight * (value - mean) / scale
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _counted(items: Iterator[tuple[set[str], int]], most: int = 200_000) -> Iterator[pd.DataFrame]:
    """Document counts of (pattern, label), given out whenever there are many."""
    counts: Counter = Counter()

    def frame() -> pd.DataFrame:
        return pd.DataFrame([(p, y, n) for (p, y), n in counts.items()], columns=["pattern", "label", "n"])

    for found, label in items:
        counts.update((p, label) for p in found)
        if len(counts) > most:
            yield frame()
            counts.clear()
    yield frame()


def _by_label(rows: DataFrame, find) -> DataFrame:
    """Documents of either label that hold each pattern ``find(words)`` gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _counted((find(fold(t)), y) for b in batches for t, y in zip(b["text"], b["label"], strict=True))

    counts = rows.select("text", "label").mapInPandas(run, "pattern string, label int, n long")
    toxic = F.col("label") == 1
    return counts.groupBy("pattern").agg(
        F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(toxic, 0).otherwise(F.col("n"))).alias("clean"),
    )


def _beginnings(words: list[str]) -> set[str]:
    return {p for w in set(words) for p in patterns_of(w)}


def training_rows(docs: DataFrame, labels: DataFrame, where: Column | None = None, most: int = TRAINING_ROWS) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents. ``where`` limits the ids learned from."""
    ids = labels.select("doc_id", F.col("toxic").alias("label")).where("doc_id is not null and label is not null")
    if where is not None:
        ids = ids.where(where)
    ids = ids.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label")


def fit(rows: DataFrame) -> Model:
    """Learn a model from (text, label); ``training_rows`` bounds them."""
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(coefficients=[math.inf if toxic else -math.inf] + [0.0] * 4)
    odds = F.log((F.col("toxic") + 0.5) / (toxic - F.col("toxic") + 0.5)) - F.log(
        (F.col("clean") + 0.5) / (clean - F.col("clean") + 0.5)
    )
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    learned = (
        _by_label(rows, _beginnings)
        .where(F.col("toxic") >= MIN_DOCUMENTS)
        .select("pattern", odds.alias("weight"), error.alias("error"))
        .where(F.col("weight") - 2 * F.col("error") > 1)
        .orderBy(F.desc("weight"), "pattern")
        .limit(MAX_PATTERNS)
    )
    model = Model(weights={r["pattern"]: r["weight"] for r in learned.collect()})
    phrases = _by_label(rows, lambda words: {p for _, *pair in model.hits(words) for p in pair if p})
    exceptions = phrases.where((F.col("clean") >= MIN_DOCUMENTS) & (F.col("toxic") == 0))
    exceptions = exceptions.orderBy(F.desc("clean"), "pattern").limit(MAX_EXCEPTIONS).collect()
    model = Model(weights=model.weights, exceptions=frozenset(r["pattern"] for r in exceptions))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = np.array([model.features(fold(t)) for t in b["text"]]).reshape(-1, 4)
            yield pd.DataFrame({**{f"f{k}": values[:, k] for k in range(4)}, "label": b["label"]})

    table = rows.select("text", "label").mapInPandas(features, "f0 double, f1 double, f2 double, f3 double, label int")
    table = table.toPandas().sort_values(["f0", "f1", "f2", "f3", "label"])
    return _curve(model, table[["f0", "f1", "f2", "f3"]].to_numpy(), table["label"].to_numpy(float))


def _curve(model: Model, values: np.ndarray, label: np.ndarray, ridge: float = 1.0) -> Model:
    """Fit the logistic curve by Newton's method."""
    mean, scale = values.mean(axis=0), values.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(values)), (values - mean) / scale])
    w, penalty = np.zeros(5), np.diag([1e-6] + [ridge] * 4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        w += np.linalg.solve(hessian, x.T @ (label - p) - penalty @ w)
    model.mean, model.scale, model.coefficients = mean.tolist(), scale.tolist(), w.tolist()
    return model


def toxicity(model: Model, text: Column | str = "text") -> Column:
    """The score of a text, as a column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(text)


def is_held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from learning."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a corpus. The bounded training rows are written once: fitting reads them several times."""
    rows = training_rows(docs, labels, ~is_held_out(F.col("doc_id")))
    return fit(written(docs.sparkSession, rows, "training"))
