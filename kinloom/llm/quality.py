"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Every word has a row by its hash and one by its shape (classes of its first and last characters, and length). A row's index
vector is a fixed sparse vector of a few +1 and -1; its context vector is the sum of the index vectors around it in the
fitting sample. A document is the mean and spread of its words' vectors and how much neighbouring words agree.
The network's logits are divided by a temperature fitted on a part of the sample that its weights never saw.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, fold, sampled_texts
from .textparts import joined, parts, word_bounds, word_hashes

FOLDS, HELD_OUT = 5, 0
REJECT_BELOW = 0.3
SAMPLE_ROWS = 3_000  # for each label
SAMPLE_CHARS = 32_000_000  # of all sampled texts together
POOLED = 1 << 18  # characters whose words are pooled at once
BITS = 16
SIZE = 32
NONZERO = 4
HIDDEN = 32
CLASS = np.full(256, 3, np.int64)
CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 0
CLASS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 1
CLASS[np.frombuffer(b"0123456789", np.uint8)] = 2
CLASS[128:] = 4
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def index_vectors(rows: int) -> np.ndarray:
    """The index vector of each row: `NONZERO` places of +1 or -1, the same in every run."""
    maker = np.random.default_rng(20_240_229)
    out = np.zeros((rows, SIZE), np.float32)
    places = np.argsort(maker.random((rows, SIZE), dtype=np.float32), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, maker.choice(np.array([-1, 1], np.float32), (rows, NONZERO)), axis=1)
    return out


def word_rows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, its row by hash, its row by shape)."""
    starts, ends = word_bounds(data)
    by_hash = (word_hashes(LOWER[data], starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    last, before = data[ends - 1].astype(np.int64), CLASS[data[np.maximum(ends - 2, starts)]]
    length = np.minimum(ends - starts, 8) - 1
    shape = ((CLASS[data[starts]] * 5 + before) * 8 + length) * 256 + last
    return starts, by_hash, shape % (1 << BITS) + (1 << BITS)


@dataclass
class Pooled:
    """Sums over the words of each document."""

    table: np.ndarray

    def features(self, texts: list[str | None]) -> np.ndarray:
        """One row for each text; a text without words has zeros."""
        n = len(texts)
        sums, squares, rest = np.zeros((n, SIZE)), np.zeros((n, SIZE)), np.zeros((n, 4))
        for part in parts(texts, POOLED):
            data, begins = joined(part)
            starts, by_hash, shape = word_rows(data)
            if not len(starts):
                continue
            vectors = self.table[by_hash] + self.table[shape]
            owner = np.searchsorted(begins, starts, side="right") - 1
            edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            text = np.array([i for i, _ in part])[owner[edges]]
            np.add.at(sums, text, np.add.reduceat(vectors, edges, axis=0))
            np.add.at(squares, text, np.add.reduceat(vectors * vectors, edges, axis=0))
            norms = np.sqrt((vectors * vectors).sum(axis=1)) + 1e-6
            next_same = np.append(owner[1:] == owner[:-1], False)
            agree = np.zeros(len(starts))
            agree[:-1] = (vectors[:-1] * vectors[1:]).sum(axis=1) / (norms[:-1] * norms[1:])
            equal = np.append(by_hash[1:] == by_hash[:-1], False)
            more = np.stack((np.ones(len(starts)), next_same, np.where(next_same, agree, 0), equal & next_same), axis=1)
            np.add.at(rest, text, np.add.reduceat(more, edges, axis=0))
        words, pairs = np.maximum(rest[:, :1], 1), np.maximum(rest[:, 1:2], 1)
        mean = sums / words
        spread = np.sqrt(np.maximum(squares / words - mean * mean, 0))
        length = np.sqrt((mean * mean).sum(axis=1, keepdims=True))
        return np.concatenate((mean, spread, length, rest[:, 2:] / pairs, np.log1p(rest[:, :1])), axis=1).astype(np.float32)


def context_table(texts: list[str | None], window: int = 2) -> np.ndarray:
    """The context vectors, of length one, of all rows; rows that the texts don't have keep their index vectors."""
    index = index_vectors(2 << BITS)
    table = np.zeros_like(index)
    for part in parts(texts):
        data, begins = joined(part)
        starts, by_hash, shape = word_rows(data)
        owner = np.searchsorted(begins, starts, side="right") - 1
        own = index[by_hash] + index[shape]
        around = np.zeros_like(own)
        for step in range(1, window + 1):
            same = (owner[step:] == owner[:-step])[:, None]
            around[step:] += own[:-step] * same
            around[:-step] += own[step:] * same
        for rows in (by_hash, shape):
            order = np.argsort(rows, kind="stable")
            sorted_rows = rows[order]
            edges = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1]))) if len(rows) else np.empty(0, np.int64)
            if len(edges):
                table[sorted_rows[edges]] += np.add.reduceat(around[order], edges, axis=0)
    length = np.sqrt((table * table).sum(axis=1, keepdims=True))
    return np.where(length > 0, table / np.maximum(length, 1e-6), index / NONZERO**0.5).astype(np.float32)


@dataclass
class Model:
    """All that scoring needs; `rate` is the share of label 1, which texts without words get."""

    table: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float
    rate: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = Pooled(self.table).features(texts)
        logit = _forward((x - self.centre) / self.scale, self.weights)[0] / self.temperature
        score = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return np.where(x[:, -1] > 0, score, self.rate)


def _forward(x: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = weights
    hidden = np.maximum(x @ w1 + b1, 0)
    return (hidden @ w2 + b2)[:, 0], hidden


def _train(x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> list[np.ndarray]:
    maker = np.random.default_rng(7)
    weights = [maker.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), maker.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, 1)), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = maker.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            logit, hidden = _forward(x[rows], weights)
            error = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[rows]) / len(rows))[:, None]
            back = error @ weights[2].T * (hidden > 0)
            grads = [x[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            for k, g in enumerate(grads):
                g = g + decay * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return weights


def fit(texts: list[str], labels: list[int], share: float) -> Model:
    """The model for labelled texts, in which `share` is the part of label 1 among all labelled rows.

    Without any row, or with one label only, every score is that share (1/2 without rows).
    """
    table = context_table(texts)
    y = np.array(labels, np.float64)
    x = Pooled(table).features(texts) if len(texts) else np.zeros((1, 2 * SIZE + 4), np.float32)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    zeros = [np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)]
    rate = float(np.clip(share, 1e-3, 1 - 1e-3))
    prior = np.log(rate / (1 - rate))
    if len(set(labels)) < 2:
        zeros[3][0] = prior
        return Model(table, centre, scale, zeros, 1.0, rate)
    z = (x - centre) / scale
    apart = np.arange(len(z)) % 5 == 4
    weights = _train(z[~apart], y[~apart])
    # the sample has as many rows of one label as of the other; the logits are moved to the labels' true share
    drawn = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    logit, target = (_forward(z[apart], weights)[0], y[apart]) if apart.any() else (_forward(z, weights)[0], y)
    choices = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.logaddexp(0, np.where(target > 0, -logit, logit) / t).mean() for t in choices]
    temperature = float(choices[int(np.argmin(loss))])
    weights[3] = weights[3] + temperature * (prior - np.log(drawn / (1 - drawn)))
    return Model(table, centre, scale, weights, temperature, rate)


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    """Fits on about `SAMPLE_ROWS` labelled rows of each label outside the held-out fold, on fewer if their texts exceed `SAMPLE_CHARS`."""
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).where(fold(id_column, FOLDS) != HELD_OUT)
    known = known.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    chosen = bounded_sample(known, "id", "y", SAMPLE_ROWS).dropDuplicates(["id"])
    rows = sampled_texts(docs, chosen, id_column, text_column, SAMPLE_CHARS)
    return fit(rows["text"].tolist(), rows["y"].tolist(), counts.get(1, 0) / sum(counts.values()) if counts else 0.5)


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id long, held_out boolean, score double, predicted int), one row for each row of `docs`.

    Null, empty and blank texts score the share of label 1; a null id stays null and counts as empty text for its fold; equal texts
    score equally; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.scores(batch.column(2).to_pylist()), pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), (fold(id_column, FOLDS) == HELD_OUT).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    scored = arrow_map(rows, run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= REJECT_BELOW).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_column: str = "text", reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text scores at least `reject_below`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else str(t) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(shared.value.scores(texts) >= reject_below))

    return arrow_map(docs, run, docs.schema)
