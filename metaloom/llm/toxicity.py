"""Toxicity: a convolutional text classifier over hashed word embeddings.

Training runs in numpy on a bounded sample of labelled rows; scoring is a pass over all
documents without a shuffle, the model being a broadcast of fixed size.

Defined results: a null text is an empty one and gets the score of no evidence; a null
doc_id is kept and counts as an empty string in fold and sample; repeated rows are each
scored; of several labels of one doc_id the largest holds; with an empty or one-sided
sample every score is the share of toxic rows (0.5 where there are none).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_of, in_frames, released, small_batches, text_of, trimmed

WORD = re.compile(r"\w+")
CUT = 0.7


@dataclass(frozen=True)
class Settings:
    """sample, sample_chars: the most labelled rows, and characters of them, that are fitted on; cache: distinct words a
    worker remembers; language_rows: languages with fewer rows in the sample share one threshold.
    """

    sample: int = 6000
    sample_chars: int = 100_000_000
    language_rows: int = 30
    buckets: int = 1 << 16
    size: int = 12
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    prefixes: tuple[int, ...] = (3, 4, 5, 6)
    epochs: int = 4
    rate: float = 0.05
    seed: int = 7
    window: int = 1 << 15
    cache: int = 60_000


class Vocabulary:
    """Numbers of words, and the buckets of each: the word's own, and those of its prefixes."""

    def __init__(self, s: Settings):
        self.s, self.ids = s, {}
        self.rows: list[list[int]] = []

    def encode(self, text: str) -> np.ndarray:
        ids, out = self.ids, []
        for w in WORD.findall(text.lower()):
            i = ids.get(w)
            if i is None:
                i = ids[w] = len(ids)
                self.rows.append(self.buckets(w))
            out.append(i)
        return np.array(out, np.int64)

    def buckets(self, w: str) -> list[int]:
        n = self.s.buckets
        own = zlib.crc32(w.encode("utf-8", "replace")) % n
        return [own, *(zlib.crc32(f"^{w[:k]}".encode("utf-8", "replace")) % n if len(w) >= k else own for k in self.s.prefixes)]


class Known:
    """A worker's words and what the model makes of each: only new words are multiplied, and all are forgotten beyond the cache."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.vocabulary = Vocabulary(self.model.settings)
        self.matrix = self.model.matrix(np.zeros((0, 1 + len(self.model.settings.prefixes)), np.int64))
        self.size = 0

    def encode(self, text: str) -> np.ndarray:
        if self.size > self.model.settings.cache:
            self.clear()
        ids = self.vocabulary.encode(text)
        new = np.asarray(self.vocabulary.rows, np.int64)
        if len(new):
            if self.size + len(new) > len(self.matrix):
                room = np.empty((max(4096, self.size + 2 * len(new), 3 * self.size // 2), self.matrix.shape[1]), np.float32)
                room[: self.size] = self.matrix[: self.size]
                self.matrix = room
            self.matrix[self.size : self.size + len(new)] = self.model.matrix(new)
            self.size += len(new)
            self.vocabulary.rows.clear()
        return ids


@dataclass
class Model:
    settings: Settings
    table: np.ndarray  # buckets x size
    kernels: list[np.ndarray]  # width x size x filters
    biases: list[np.ndarray]
    head: np.ndarray
    offset: float
    languages: list[str]
    speech: np.ndarray  # buckets x languages, log probabilities of words
    cuts: np.ndarray  # a threshold for each language

    def words(self, rows: list[list[int]] | np.ndarray) -> np.ndarray:
        return self.table[np.asarray(rows, np.int64)].mean(axis=1)

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        """For words given by their buckets: products with each offset of each filter, then log probabilities in each language."""
        out = np.empty((len(rows), sum(len(k) * k.shape[2] for k in self.kernels) + self.speech.shape[1]), np.result_type(self.table, *self.kernels, self.speech))
        for at in range(0, len(rows), 20_000):
            part = rows[at : at + 20_000]
            vectors = self.words(part)
            np.concatenate([*(vectors @ k[j] for k in self.kernels for j in range(len(k))), self.speech[part[:, 0]]], axis=1, out=out[at : at + len(part)])
        return out

    def read(self, ids: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, int]:
        """Max over all positions of each filter, and the language; long texts in overlapping windows."""
        s = self.settings
        most = [np.zeros(s.filters, np.float32) for _ in s.widths]
        heard = np.zeros(len(self.languages))
        for at in range(0, len(ids), s.window):
            rows = matrix[ids[at : at + s.window + max(s.widths) - 1]]
            heard += rows[: s.window, -len(heard) :].sum(axis=0)
            column = 0
            for g, w in enumerate(s.widths):
                n = min(s.window, len(rows) - w + 1)
                if n > 0:
                    total = rows[:n, column : column + s.filters]
                    for j in range(1, w):
                        total = total + rows[j : j + n, column + j * s.filters : column + (j + 1) * s.filters]
                    most[g] = np.maximum(most[g], total.max(axis=0) + self.biases[g])
                column += w * s.filters
        return np.concatenate(most), int(heard.argmax())

    def scores(self, texts: list[str], known: Known) -> np.ndarray:
        """Probabilities, moved in log odds so that each language's own threshold comes to CUT."""
        z, lang = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            ids = known.encode(text)
            pooled, lang[i] = self.read(ids, known.matrix)
            z[i] = pooled @ self.head + self.offset
        return np.round(sigmoid(z - logit(self.cuts[lang]) + logit(np.array(CUT))), 6)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def constant(share: float, s: Settings) -> Model:
    z = float(logit(np.clip(np.array(share), 1e-3, 1 - 1e-3)))
    kernels = [np.zeros((w, s.size, s.filters), np.float32) for w in s.widths]
    return Model(s, np.zeros((s.buckets, s.size), np.float32), kernels, [np.zeros(s.filters, np.float32) for _ in s.widths], np.zeros(s.filters * len(s.widths), np.float32), z, [""], np.zeros((s.buckets, 1), np.float32), np.array([CUT]))


def association(bags: list[np.ndarray], y: np.ndarray, buckets: int) -> np.ndarray:
    """How far each bucket's documents lean to the toxic side, in standard deviations; the embeddings start from it."""
    toxic, all_ = np.zeros(buckets), np.zeros(buckets)
    for bag, label in zip(bags, y, strict=True):
        all_[bag] += 1
        toxic[bag] += label
    hoped = all_ * y.mean()
    return np.clip((toxic - hoped) / np.sqrt(hoped + 3) / 10, -1, 1)


def train(rows: list[tuple[str, str, int]], s: Settings) -> Model:
    """rows: text, language, label. A quarter of them is set aside for the thresholds."""
    y = np.array([r[2] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return constant(y.mean() if len(y) else 0.5, s)
    rng = np.random.default_rng(s.seed)
    vocabulary = Vocabulary(s)
    coded = [vocabulary.encode(r[0]) for r in rows]
    buckets = np.asarray(vocabulary.rows or [[0] * (1 + len(s.prefixes))], np.int64)
    del vocabulary  # its lists take more than all that follows
    trimmed()
    aside = np.arange(len(rows)) % 4 == 3
    if y[~aside].min() == y[~aside].max():
        aside[:] = False
    fit = np.flatnonzero(~aside)
    bags = [np.unique(buckets[np.unique(coded[i])]) if len(coded[i]) else np.zeros(0, np.int64) for i in fit]
    table = rng.normal(0, 0.02, (s.buckets, s.size)).astype(np.float32)
    table[:, 0] = association(bags, y[fit], s.buckets)
    kernels = [rng.normal(0, 0.3, (w, s.size, s.filters)).astype(np.float32) for w in s.widths]
    for k in kernels:
        k[:, 0, :] = np.abs(k[:, 0, :]) + 0.3
    biases = [np.full(s.filters, -0.1, np.float32) for _ in s.widths]
    head = np.full(s.filters * len(s.widths), 0.3, np.float32)
    base = y[fit].mean()
    model = Model(s, table, kernels, biases, head, float(logit(np.array(base))), [""], np.zeros((s.buckets, 1), np.float32), np.array([CUT]))
    learn(model, [coded[i] for i in fit], y[fit], buckets, rng)
    languages(model, rows, coded, buckets, fit)
    thresholds(model, coded, buckets, np.flatnonzero(aside) if aside.any() else fit, y)
    return model


def gradients(model: Model, ids: np.ndarray, buckets: np.ndarray, label: float, weight: float = 1.0) -> dict:
    """Of the weighted log loss of one document: by head, offset, biases, kernels, and rows of the table (pairs of buckets and change).

    The gradient of a maximum goes to the words of its position.
    """
    s = model.settings
    distinct, where = np.unique(ids, return_inverse=True)
    vectors = model.words(buckets[distinct]) if len(ids) else np.zeros((0, s.size), np.float32)
    values, spots = [], []
    for w, k, b in zip(s.widths, model.kernels, model.biases, strict=True):
        n = len(ids) - w + 1
        if n <= 0:
            values.append(np.zeros(s.filters, np.float32))
            spots.append((None, np.zeros(s.filters, bool)))
            continue
        total = (vectors @ k[0])[where[:n]]
        for j in range(1, w):
            total = total + (vectors @ k[j])[where[j : j + n]]
        at = total.argmax(axis=0)
        top = total[at, np.arange(s.filters)] + b
        values.append(np.maximum(top, 0))
        spots.append((at, top > 0))
    pooled = np.concatenate(values)
    error = float(sigmoid(np.array(pooled @ model.head + model.offset)) - label) * weight
    back = error * model.head
    out = {"head": error * pooled, "offset": error, "biases": [], "kernels": [], "table": []}
    for g, (w, (at, on)) in enumerate(zip(s.widths, spots, strict=True)):
        grad = np.where(on, back[g * s.filters : (g + 1) * s.filters], 0).astype(np.float32)
        kernel = np.zeros_like(model.kernels[g])
        for j in range(w if on.any() else 0):
            word = where[at + j]
            kernel[j] = vectors[word].T * grad
            touched = buckets[distinct[word]]
            change = (model.kernels[g][j] * grad).T / touched.shape[1]
            out["table"] += [(touched[f], change[f]) for f in np.flatnonzero(on)]
        out["biases"].append(grad)
        out["kernels"].append(kernel)
    return out


def learn(model: Model, docs: list[np.ndarray], y: np.ndarray, buckets: np.ndarray, rng) -> None:
    """Adagrad over single documents."""
    s = model.settings
    sums = {"head": np.full_like(model.head, 1e-2), "offset": 1e-2, "biases": [np.full_like(b, 1e-2) for b in model.biases], "kernels": [np.full_like(k, 1e-2) for k in model.kernels], "table": np.full_like(model.table, 1e-1)}
    weight = np.where(y == 1, min(5.0, (1 - y.mean()) / y.mean()), 1.0)

    def step(value, seen, grad):
        seen += grad * grad
        value -= s.rate * grad / np.sqrt(seen)

    for _ in range(s.epochs):
        for i in rng.permutation(len(docs)):
            found = gradients(model, docs[i], buckets, y[i], weight[i])
            step(model.head, sums["head"], (found["head"] + 1e-4 * model.head).astype(np.float32))
            sums["offset"] += found["offset"] ** 2
            model.offset -= s.rate * found["offset"] / np.sqrt(sums["offset"])
            for g, grad in enumerate(found["biases"]):
                if grad.any():
                    step(model.biases[g], sums["biases"][g], grad)
                    step(model.kernels[g], sums["kernels"][g], found["kernels"][g])
            for rows, change in found["table"]:
                seen = sums["table"][rows] + change**2
                sums["table"][rows] = seen
                model.table[rows] -= 0.3 * s.rate * change / np.sqrt(seen)


def languages(model: Model, rows, coded, buckets: np.ndarray, fit: np.ndarray) -> None:
    """A naive Bayes table that names a text's language from its words, so that scores need no lang column."""
    of_row = [r[1] or "" for r in rows]
    common = {name for name, n in Counter(of_row).items() if n >= model.settings.language_rows}
    of_row = [name if name in common else "" for name in of_row]
    names = sorted(set(of_row))
    counts = np.full((model.settings.buckets, len(names)), 0.1)
    for i in fit:
        np.add.at(counts[:, names.index(of_row[i])], buckets[coded[i], 0], 1)
    model.languages, model.speech = names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def thresholds(model: Model, coded, buckets, aside: np.ndarray, y: np.ndarray) -> None:
    """For each language the middle of the gap that tells its set-aside rows apart best, drawn to the one of all rows where there are few."""
    matrix = model.matrix(buckets)
    found = [model.read(coded[i], matrix) for i in aside]
    z = np.array([pooled @ model.head + model.offset for pooled, _ in found])
    lang = np.array([k for _, k in found])
    whole = best(z, y[aside])
    cuts = []
    for k in range(len(model.languages)):
        own = lang == k
        few = min((y[aside][own] == 1).sum(), (y[aside][own] == 0).sum())
        share = few / (few + 5)
        cuts.append(share * best(z[own], y[aside][own]) + (1 - share) * whole if few else whole)
    model.cuts = np.clip(sigmoid(np.array(cuts)), 0.02, 0.98)


def best(z: np.ndarray, y: np.ndarray) -> float:
    """The cut of the highest F1; of equal ones the middle."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(len(y)) + 1 + y.sum())
    i = int(f1.argmax())
    return float((z[i] + z[min(i + 1, len(z) - 1)]) / 2)


def sample(documents: DataFrame, labels: DataFrame, s: Settings) -> list[tuple[str, str, int]]:
    """Labelled rows outside the held-out fold, those with the smallest hash of their id: as many as both bounds let in. A text that is over the bound of characters alone is passed over."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.where(fold_of("doc_id", 3) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    rows = documents.select("doc_id", text_of().alias("text"), "lang").join(F.broadcast(chosen), "doc_id").where(F.length("text") <= s.sample_chars)
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    rows = rows.orderBy(*order).limit(s.sample).withColumn("chars", F.sum(F.length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return [(r.text, r.lang, int(r.toxic > 0)) for r in rows.where(F.col("chars") <= s.sample_chars).select("text", "lang", "toxic").collect()]


def _fitted(documents: DataFrame, labels: DataFrame, s: Settings):
    model = train(sample(documents, labels, s), s)
    trimmed()
    return documents.sparkSession.sparkContext.broadcast(model)


def score(documents: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = _fitted(documents, labels, settings or Settings())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(model.value)
        for frame in frames:
            found = model.value.scores(frame["text"].tolist(), known)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": found, "predicted": (found >= CUT).astype(np.int32)})

    rows = documents.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), text_of().alias("text"))
    return in_frames(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(documents: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns. Scored beside the row, so no join follows."""
    model = _fitted(documents, labels, settings or Settings())

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        released()
        known = Known(model.value)
        for part in parts:
            yield pd.Series(model.value.scores(part.tolist(), known))

    small_batches(documents.sparkSession)
    return documents.where(rate(text_of()) < CUT)
