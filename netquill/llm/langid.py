"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed character 1- to 4-grams (over the bytes, other characters than letters
as blanks), and a linear layer with softmax turns the average into language probabilities. Embeddings and layer are trained by
stochastic gradient descent in numpy, on a bounded sample of labelled rows whose size is a parameter; a share of the sample
is kept aside to fit the temperature of the softmax and the score below which a prediction counts as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import crc_mod, random_words, text_chunks

#: Rows of a fit at most, chosen by the hash of their id over the whole table.
SAMPLE_ROWS = 4000
BUCKETS = 4096
DIMENSIONS = 16
MAX_GRAM = 4
UNKNOWN = "und"
_CHUNK_BYTES = 1 << 20

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_SALTS = random_words(5, MAX_GRAM + 1) | np.uint64(1)


def gram_counts(data: np.ndarray, offsets: np.ndarray, buckets: int) -> np.ndarray:
    """Texts x buckets: how often each hashed gram occurs. Grams do not cross texts; runs of blanks give nothing new."""
    n = len(offsets) - 1
    out = np.zeros(n * buckets, np.float32)
    letters = _LETTERS[data]
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * buckets
    end = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    code = np.zeros(len(data), np.uint64)
    for size in range(1, MAX_GRAM + 1):
        usable = len(data) - size + 1
        if usable <= 0:
            break
        code = (code[:usable] << np.uint64(8)) | letters[size - 1 :]
        keep = (end[:usable] >= size) & ((letters[:usable] != 0x20) | (letters[size - 1 :] != 0x20))
        with np.errstate(over="ignore"):
            bucket = ((code[keep] + np.uint64(size)) * _SALTS[size]) >> shift
        out += np.bincount(text[:usable][keep] + bucket.astype(np.int64), minlength=n * buckets).astype(np.float32)
    return out.reshape(n, buckets)


def _averages(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    embeddings: np.ndarray  # buckets x dimensions
    weights: np.ndarray  # dimensions x languages
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return _averages(counts) @ self.embeddings @ self.weights + self.bias


def train(counts: np.ndarray, labels: list[str], seed: int = 1, epochs: int = 30, rate: float = 0.5, batch: int = 32, accuracy: float = 0.995) -> LanguageModel:
    """Fit embeddings and softmax by SGD; a fifth of the rows only calibrates."""
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 50 else (order, order)
    x = _averages(counts) * np.float32(np.sqrt(counts.shape[1]))  # unit scale for the step size; folded back below
    m = LanguageModel(languages, rng.normal(0, 1 / DIMENSIONS, (counts.shape[1], DIMENSIONS)), rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages)))
    steps, total = 0, epochs * -(-len(used) // batch)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(used), -(-len(used) // batch)):
            step = rate * (1 - steps / total)
            steps += 1
            h = x[at] @ m.embeddings
            error = _softmax(h @ m.weights + m.bias)
            error[np.arange(len(at)), y[at]] -= 1
            error /= len(at)
            back = error @ m.weights.T
            m.weights -= step * (h.T @ error)
            m.bias -= step * error.sum(0)
            m.embeddings -= step * (x[at].T @ back)
    m.embeddings *= np.sqrt(counts.shape[1])
    z, t = m.logits(counts[held]), y[held]
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(z / g)[np.arange(len(t)), t], 1e-12)).mean() for g in grid]
    m.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / m.temperature)
    top, right = p.max(1), p.argmax(1) == t
    by_score = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[by_score]) / np.arange(1, len(t) + 1) >= accuracy)
    m.reject_below = float(top[by_score[good[-1]]]) if len(good) else 1.0
    return m


def fit(docs: DataFrame, learn: Column, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> LanguageModel | None:
    """A model of the rows that ``learn`` selects and that have text and label; None if there are none.

    The rows are the ``sample`` smallest hashes of id and text: the ids and labels are never features.
    """
    rows = docs.filter(F.coalesce(learn, F.lit(False)) & F.col(label).isNotNull() & (F.length(text) > 0))
    rows = rows.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.xxhash64(F.col(key), F.length(text)).alias("order"))
    last = rows.select("order").orderBy("order").limit(sample).agg(F.max("order")).first()[0]
    if last is None:
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in text_chunks(b.column("text"), _CHUNK_BYTES):
                counts = np.minimum(gram_counts(data, offsets, buckets), 65535).astype("<u2")
                yield pa.record_batch([b.column("label").slice(first, len(counts)), b.column("order").slice(first, len(counts)), pa.array([c.tobytes() for c in counts], pa.binary())], ["label", "order", "counts"])

    # at most `sample` rows of one count per bucket (more only if ids repeat)
    got = rows.filter(F.col("order") <= last).mapInArrow(counted, "label string, order long, counts binary").orderBy("order", "label", "counts").limit(sample).toPandas()
    return train(np.stack([np.frombuffer(c, "<u2") for c in got["counts"]]).astype(np.float32), got["label"].tolist())


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability), rejected; one row per row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0 and rejected; so is every text if nothing could be learned. A score
    below the calibrated limit sets ``rejected`` and leaves ``lang_pred`` as it is. Whole texts are read, long ones too; nothing but
    the text is an input. Repeated rows get equal results; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("letters"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    buckets = len(model.embeddings)
    names = np.array(model.languages, dtype=object)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in text_chunks(b.column("text"), _CHUNK_BYTES):
                n = len(offsets) - 1
                p = _softmax(model.logits(gram_counts(data, offsets, buckets)) / model.temperature)
                letters = b.column("letters").slice(first, n).to_numpy(zero_copy_only=False)
                score = np.where(letters, np.clip(p.max(1), 0, 1), 0.0)
                lang = np.where(letters, names[p.argmax(1)], UNKNOWN)
                yield pa.record_batch([b.column("doc_id").slice(first, n), pa.array(lang, pa.string()), pa.array(score), pa.array(~letters | (score < model.reject_below))], ["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(predicted, f"doc_id {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, key: str = "doc_id", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """Learn from the rows outside the held fold (crc32 of the id as text, modulo ``folds``) and predict every row."""
    held = crc_mod(F.col(key), folds) == held_fold
    model = fit(docs, ~held, key=key)
    return predict(docs, model, key=key).withColumn("held_out", crc_mod(F.col("doc_id"), folds) == held_fold)
