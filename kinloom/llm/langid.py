"""Language identification by the nearest centroid.

A text is its letter trigrams, hashed to `BUCKETS`, as a normalised TF-IDF vector. Every language has several centroids,
found by spherical k-means, and a text has the language of the centroid with the largest cosine. A text whose cosine is below
what labelled texts of that language with as many different trigrams have is rejected. Cosines grow with that number,
those of texts in other languages too, as trigrams share buckets: so every language has a threshold for each power of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, fold, sampled_texts
from .textparts import parts

FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
BUCKETS = 4096
CENTROIDS = 4
BATCH = 256  # texts whose vectors are held at once
SAMPLE_ROWS = 1_500  # for each language
SAMPLE_CHARS = 32_000_000  # of all sampled texts together
NEAR = 0.1  # the threshold where too few texts are labelled, and the least one
# A threshold lies half way between these quantiles: the low one of a language's texts, the high one of texts in others.
LOW, HIGH = 0.01, 0.95
LEAST_TEXTS = 30
BEGINNINGS = (8, 32, 128, 512, 2048)  # in characters, of some `CUT_TEXTS` texts of each language
CUT_TEXTS = 500
CLASSES = BUCKETS.bit_length()
#: Letters of the first two planes; those from the third on are ideographs up to plane 13, and none beyond.
PLANES = 2 << 16
LETTER = np.fromiter((chr(c).isalpha() for c in range(PLANES)), bool, PLANES)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def counts(texts: list[str | None]) -> np.ndarray:
    """Trigram counts of each text in lower case; what is no letter counts as one space, and texts begin and end with one."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for part in parts(texts, 1 << 19):
        flat = " " + "".join(t.lower() + " " for _, t in part)
        # lower case can change a text's length, so the owners are counted after it
        owner = np.repeat(np.arange(len(part)), [len(t.lower()) + 1 for _, t in part])
        code = np.frombuffer(flat.encode("utf-32-le"), "<u4")
        blank = ~np.where(code < PLANES, LETTER[np.minimum(code, PLANES - 1)], code < 0xE0000)
        code = np.where(blank, 32, code).astype(np.uint64)
        keep = np.concatenate(([True], ~(blank[1:] & blank[:-1])))
        owner = np.concatenate(([0], owner))[keep]
        code = code[keep]
        if len(code) < 3:
            continue
        key = code[:-2] << np.uint64(42) | code[1:-1] << np.uint64(21) | code[2:]
        bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)).astype(np.int64)
        mine = owner[1:-1]
        whole = (owner[2:] == mine) | (code[2:] == 32)
        for at in range(0, len(part), 256):
            a, b = np.searchsorted(mine, [at, min(at + 256, len(part))])
            rows = min(256, len(part) - at)
            found = np.bincount((mine[a:b] - at)[whole[a:b]] * BUCKETS + bucket[a:b][whole[a:b]], minlength=rows * BUCKETS).reshape(rows, BUCKETS)
            np.add.at(out, [i for i, _ in part[at : at + 256]], found.astype(np.float32))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def _size_class(x: np.ndarray) -> np.ndarray:
    """The power of two up to the number of buckets that each vector has."""
    return np.log2(np.maximum(1, (x > 0).sum(axis=1))).astype(np.int64)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of each centroid
    nearest: dict[str, np.ndarray]  # the least cosine that a text of the language may have, by _size_class()

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        return _unit(np.log1p(counts(texts)) * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, whether it is rejected) of each text."""
        language, score, rejected = [], np.zeros(len(texts)), np.ones(len(texts), bool)
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            if not self.languages:
                language += [UNKNOWN] * len(part)
                continue
            x = self.vectors(part)
            cosine, size = x @ self.centroids.T, _size_class(x)
            for i, (text, best) in enumerate(zip(part, cosine.argmax(axis=1).tolist(), strict=True)):
                if has_letter(text):
                    language.append(self.languages[best])
                    score[at + i] = min(1.0, max(0.0, float(cosine[i, best])))
                    rejected[at + i] = score[at + i] < self.nearest[language[-1]][size[i]]
                else:
                    language.append(UNKNOWN)
        return language, score, rejected


def _centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the mean and then, one after the other, the vector farthest from those chosen."""
    chosen = [_unit(x.mean(axis=0, keepdims=True))[0]]
    near = x @ chosen[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[int(near.argmin())])
        near = np.maximum(near, x @ chosen[-1])
    centres = np.stack(chosen)
    for _ in range(rounds):
        group = (x @ centres.T).argmax(axis=1)
        used = np.unique(group)
        fresh = _unit(np.stack([x[group == g].mean(axis=0) for g in used]))
        if fresh.shape == centres.shape and np.allclose(fresh, centres, atol=1e-6):
            break
        centres = fresh
    return centres


def fit(texts: list[str], languages: list[str]) -> Model:
    """The model for texts with known languages; texts without a letter are left out. Without any it predicts nothing."""
    rows = [(t, g) for t, g in zip(texts, languages, strict=True) if has_letter(t)]
    if not rows:
        return Model(np.ones(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), [], {})
    texts = [t for t, _ in rows]
    seen = np.zeros(BUCKETS)
    for at in range(0, len(texts), 512):
        seen += (counts(texts[at : at + 512]) > 0).sum(axis=0)
    idf = (np.log((1 + len(texts)) / (1 + seen)) + 1).astype(np.float32)
    model = Model(idf, np.zeros((0, BUCKETS), np.float32), [], {})
    found = []
    for language in sorted({g for _, g in rows}):
        mine = [t for t, g in rows if g == language]
        centres = _centroids(np.concatenate([model.vectors(mine[at : at + 512]) for at in range(0, len(mine), 512)]), CENTROIDS)
        found.append(centres)
        model.languages += [language] * len(centres)
    model.centroids = np.concatenate(found).astype(np.float32)
    model.nearest = _thresholds(model, rows)
    return model


def _elsewhere(text: str, plane: int) -> str:
    """`text` with its letters moved to another plane of Unicode: as long and as repetitive, and no trigram of a known language."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").copy()
    code[LETTER[np.minimum(code, 0xFFFF)] & (code <= 0xFFFF)] += plane << 16  # each is a letter there, as 2 <= plane <= 13
    return code.tobytes().decode("utf-32-le")


def _thresholds(model: Model, rows: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """The least cosine of each language and size class, from the labelled texts and beginnings of several lengths.

    What is to be rejected are texts of the other languages and texts in no language. Where these are as near as
    the language's own, only the lowest of its own are rejected. No threshold is below `NEAR`, or below half the low quantile
    of the language's texts if this is less; a class with few texts has the threshold of the next smaller one.
    """
    names = sorted(set(model.languages))
    own, other = ({g: ([], []) for g in names} for _ in range(2))  # size classes and cosines
    cut = []
    for g in names:
        mine = [t for t, h in rows if h == g]
        cut += [(t[:n], g) for t in mine[:: -(-len(mine) // CUT_TEXTS)] for n in (*BEGINNINGS, len(t)) if n <= len(t) and has_letter(t[:n])]
    cut += [(_elsewhere(t, 2 + i % 12), None) for i, (t, _) in enumerate(cut)]
    whole, given = {g: sum(h == g for _, h in rows) for g in names}, rows + cut
    for at in range(0, len(given), 512):
        some = given[at : at + 512]
        x = model.vectors([t for t, _ in some])
        cosine, size, of = x @ model.centroids.T, _size_class(x), np.array([g or "" for _, g in some])
        for g in names:
            near = cosine[:, [h == g for h in model.languages]].max(axis=1)
            for held, these in ((own[g], of == g), (other[g], of != g)):
                held[0].append(size[these])
                held[1].append(near[these])
    out = {}
    for g in names:
        (size, near), (size_of_other, near_other) = (tuple(map(np.concatenate, held[g])) for held in (own, other))
        least = min(NEAR, 0.5 * float(np.quantile(near[: whole[g]], LOW)))
        out[g] = np.full(CLASSES, least)
        for k in range(CLASSES):
            mine, foreign = near[size == k], near_other[size_of_other == k]
            if len(mine) < LEAST_TEXTS:
                out[g][k] = out[g][max(0, k - 1)]
                continue
            low, high = np.quantile(mine, LOW), np.quantile(foreign, HIGH) if len(foreign) else 0.0
            out[g][k] = max(least, min(low, (low + high) / 2))
    return out


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> Model:
    """Fits on about `SAMPLE_ROWS` rows of each language outside the held-out fold, on fewer if their texts exceed `SAMPLE_CHARS`."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), F.col(language_column).cast("string").alias("lang"))
    rows = rows.where((fold("id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = sampled_texts(bounded_sample(rows, "id", "lang", SAMPLE_ROWS), None, "id", "text", SAMPLE_CHARS, {"lang": F.col("lang")})
    return fit(sample["text"].tolist(), sample["lang"].tolist())


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id long, held_out boolean, lang_pred string, score double, rejected boolean), one row for each row of `docs`.

    Null texts and texts without a letter are `und` with score 0 and rejected; a null id stays null and counts as
    empty text for its fold; equal texts get equal results; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language, score, rejected = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), (fold(id_column, FOLDS) == HELD_OUT).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text has a language and is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else str(t) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(~shared.value.predict(texts)[2]))

    return arrow_map(docs, run, docs.schema)
