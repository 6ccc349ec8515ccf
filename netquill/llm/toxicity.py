"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other; each linear model sees the features of the text and the probabilities of the
earlier categories. While fitting, those probabilities are out of fold, so a later model meets them as uncertain as they will be
on new text. Features are the presence of words and of word beginnings (4 to 6 letters, so that inflected forms share one) and some
shares of character kinds. Which words count is decided by a distributed count over the labelled sample.

The labelled rows of a fit are bounded by a parameter; the prediction reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Labelled rows of a fit at most, chosen by the hash of their id.
SAMPLE_ROWS = 16000
#: Words or beginnings of each category at most.
WORDS = 200
PREFIXES = (4, 5, 6)
#: Fewer documents than this say nothing about a word.
SUPPORT = 4
STYLE = 5
#: Category: the label column and the value that means the category holds; in the order of the chain.
CATEGORIES = {"unsound": ("quality", 0), "toxic": ("toxic", 1)}

_WORD = re.compile(r"[^\W\d_]+")


def features_of(words: set[str]) -> set[str]:
    """The words and their beginnings; a beginning is marked by an asterisk."""
    out = set(words)
    for w in words:
        for n in PREFIXES:
            if len(w) >= n:
                out.add(w[:n] + "*")
    return out


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def style_of(text: str | None) -> list[float]:
    text = text or ""
    n, words = max(len(text), 1), text.split()
    letters = sum(map(len, _WORD.findall(text)))
    return [np.log1p(len(text)) / 10, letters / n, text.count(" ") / n, text.count("\n") / n, len(set(words)) / max(len(words), 1)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 10) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-3:
            break
    return w


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


@dataclass
class ToxicityChain:
    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def matrix(self, texts) -> np.ndarray:
        known, width = self.vocabulary, len(self.vocabulary)
        short = {n: {k[:-1] for k in known if k[-1] == "*" and len(k) == n + 1} for n in PREFIXES}
        out = np.zeros((len(texts), width + STYLE))
        for i, t in enumerate(texts):
            if t is None:
                continue
            for w in words_of(t):
                if w in known:
                    out[i, known[w]] = 1
                for n in PREFIXES:
                    if w[:n] in short[n] and len(w) >= n:
                        out[i, known[w[:n] + "*"]] = 1
            out[i, width:] = style_of(t)
        return out

    def train(self, x: np.ndarray, labels: np.ndarray, folds: int = 4) -> None:
        """``labels``: rows x categories. Rows are dealt to folds in turn; they come in hash order."""
        fold = np.arange(len(x)) % folds
        for c in range(len(self.categories)):
            y = labels[:, c].astype(float)
            held = np.zeros(len(x))
            for f in range(folds):
                out = fold == f
                held[out] = _apply(_logistic(x[~out], y[~out]), x[out]) if (~out).any() else 0.5
            self.weights.append(_logistic(x, y))
            self.thresholds.append(_best_threshold(held, y))
            x = np.hstack([x, held[:, None]])

    def probabilities(self, texts) -> np.ndarray:
        x, out = self.matrix(texts), []
        for w in self.weights:
            out.append(_apply(w, x))
            x = np.hstack([x, out[-1][:, None]])
        return np.stack(out, 1)

    def column(self, text: Column) -> Column:
        """The probabilities of the categories, an array in their order, of a text column."""

        @pandas_udf("array<double>")
        def chain(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in parts:
                texts = s.tolist()
                yield pd.Series([p for at in range(0, len(texts), 500) for p in self.probabilities(texts[at : at + 500])], dtype=object)

        return chain(text)


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle, in log odds, of the range of thresholds with the best F1 out of fold; 0.5 if one label never occurs."""
    if y.sum() in (0, len(y)):
        return 0.5
    odds = np.linspace(-6, 6, 121)
    f1 = np.array([2 * y[p >= t].sum() / max(y.sum() + (p >= t).sum(), 1) for t in _sigmoid(odds)])
    best = odds[f1 >= f1.max() - 1e-12]
    return float(_sigmoid(np.array((best[0] + best[-1]) / 2)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", categories: dict | None = None, sample: int = SAMPLE_ROWS, words: int = WORDS) -> ToxicityChain | None:
    """Fit the chain on at most ``sample`` labelled rows; None without any. A label that is null does not count as the category.

    An id that repeats in ``labels`` holds a category if any of its rows does.
    """
    categories = CATEGORIES if categories is None else categories
    names = list(categories)
    marks = [F.max(F.coalesce(F.col(c) == v, F.lit(False)).cast("int")).alias(n) for n, (c, v) in categories.items()]
    chosen = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(*marks).orderBy(F.xxhash64("key"), "key").limit(sample)
    # bounded by `sample`
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "key")
    heard = F.array_distinct(F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: F.length(w) > 0))
    seen = rows.select(*names, F.explode(heard).alias("word"))
    begin = [F.when(F.length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in PREFIXES]
    seen = seen.select(*names, F.explode(F.array_compact(F.array("word", *begin))).alias("word"))
    counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *(F.sum(n).alias(n) for n in names)).filter(F.col("n") >= SUPPORT)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(n).alias(n) for n in names)).first()
    if not totals["n"]:
        return None
    vocabulary: dict[str, int] = {}
    for n in names:
        share = (totals[n] + 1) / (totals["n"] + 2)
        lift = (F.col(n) - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
        for r in counts.select("word", lift.alias("z")).orderBy(F.desc("z"), "word").limit(words).collect():
            vocabulary.setdefault(r["word"], len(vocabulary))
    chain = ToxicityChain(names, vocabulary)

    def as_features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                found = chain.matrix(p["text"].tolist()).astype(np.float32)
                yield p.drop(columns="text").assign(x=[r.tobytes() for r in found])

    kind = docs.schema[key].dataType.simpleString()
    got = rows.select("key", *names, "text").mapInPandas(as_features, f"key {kind}, {', '.join(f'{n} int' for n in names)}, x binary").toPandas()
    got = got.sort_values(["key", "x"], key=lambda s: s if s.name == "x" else pd.util.hash_array(s.to_numpy())).head(2 * sample)
    chain.train(np.stack([np.frombuffer(x, np.float32) for x in got["x"]]).astype(float), got[names].to_numpy())
    return chain


def score(docs: DataFrame, chain: ToxicityChain | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the probability of each category as ``<category>_probability``, ``toxic`` (the last category, at its threshold) and kept.

    One row per row of ``docs``. A null or empty text is not toxic (probability 0); neither is anything if there was nothing to
    learn from. Whole texts are read; repeated rows get equal results; other columns are not read.
    """
    names = chain.categories if chain else list(CATEGORIES)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    empty = F.coalesce(F.length("text") == 0, F.lit(True))
    p = chain.column(F.col("text")) if chain else F.array(*(F.lit(0.0) for _ in names))
    rows = rows.select("doc_id", empty.alias("empty"), p.alias("p"))
    out = rows.select("doc_id", *(F.when(F.col("empty"), 0.0).otherwise(F.col("p")[i]).alias(f"{n}_probability") for i, n in enumerate(names)))
    out = out.withColumn("toxic", F.col(f"{names[-1]}_probability") >= F.lit(chain.thresholds[-1] if chain else 2.0))
    return out.withColumn("kept", ~F.col("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, all columns as they are. See :func:`score` for empty texts."""
    chain = fit(docs, labels, key, text)
    if chain is None:
        return docs
    last, limit = len(chain.categories) - 1, chain.thresholds[-1]
    return docs.filter(F.coalesce(F.length(text) == 0, F.lit(True)) | (chain.column(F.col(text))[last] < limit))
