"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding takes lower case, drops marks and invisible characters, and writes look-alikes, digits and signs that stand for
letters as one letter of their class, in texts and lexicon alike. Lexicon and weights are learned: words whose different contexts in toxic texts
are too many to be chance; a word has the number of its texts, but of its contexts if these are fewer, so that copies of one passage count once. Exception phrases are
two words around a lexicon word that occur in clean texts and never in toxic ones.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, fold, sampled_texts
from .textparts import PART

FOLDS, HELD_OUT = 3, 1
TOXIC_FROM = 0.7
SAMPLE_ROWS = 8_000  # for each label
SAMPLE_CHARS = 32_000_000  # of all sampled texts together
CHANCE = 0.01  # for the whole vocabulary
EXCEPTION_TEXTS = 3
POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)
# Characters that look like a Latin letter, and digits and signs that are written for one.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "s", "æ": "a", "œ": "o", "ɑ": "a", "ɡ": "g",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "€": "e",
}
SAME = {"l": "i"}  # "1" stands for either
PLANES = 2 << 16


def _fold_table() -> np.ndarray:
    """The folded character of each of the first two planes; 32 for what is no letter, 0 for what is dropped."""
    table = np.full(PLANES, 32, np.uint32)
    for code in range(PLANES):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind in ("Mn", "Me", "Cf"):
            table[code] = 0
            continue
        base = unicodedata.normalize("NFKD", char.lower())[:1].lower()[:1]
        base = LOOKALIKES.get(base, base)
        if base.isalpha():
            table[code] = ord(SAME.get(base, base))
    return table


_TABLE: list[np.ndarray] = []


def folded_parts(text: str | None) -> Iterator[str]:
    """The folded text, single spaces between its words, and one before and behind, in pieces of about `PART` characters.

    Every character is folded by itself and spaces are joined across pieces, so the pieces together are the same wherever they are cut.
    """
    if not _TABLE:
        _TABLE.append(_fold_table())
    last = 32
    yield " "
    for at in range(0, len(text or ""), PART):
        code = np.frombuffer(text[at : at + PART].encode("utf-32-le"), "<u4")
        # beyond the first two planes are ideographs, which stay, and from plane 14 on tags and selectors, which are dropped
        out = np.where(code < PLANES, _TABLE[0][np.minimum(code, PLANES - 1)], np.where(code < 0xE0000, code, 0))
        out = np.concatenate(([last], out[out != 0])).astype("<u4")
        keep = (out[1:] != 32) | (out[:-1] != 32)
        last = int(out[-1])
        yield out[1:][keep].tobytes().decode("utf-32-le")
    if last != 32:
        yield " "


def folded(text: str | None) -> str:
    return "".join(folded_parts(text))


@dataclass
class Model:
    weights: dict[str, float]
    exceptions: list[str]
    power: float = 0.0
    slope: float = 0.0
    offset: float = -3.0

    def __post_init__(self) -> None:
        self._matcher = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_matcher": None}

    def matcher(self) -> ahocorasick.Automaton:
        if self._matcher is None:
            self._matcher = ahocorasick.Automaton()
            for word, weight in self.weights.items():
                self._matcher.add_word(f" {word} ", (len(word), weight))
            for phrase in self.exceptions:
                self._matcher.add_word(f" {phrase} ", (len(phrase), 0.0))
            self._matcher.make_automaton()
        return self._matcher

    def evidence(self, text: str | None) -> tuple[float, int]:
        """(sum of the weights of matches that lie in no exception phrase, number of words)."""
        words, hits, starts, ends = -1, [], set(), set()
        found = self.matcher().iter("") if self.weights else None
        for flat in folded_parts(text):
            words += flat.count(" ")
            if found is None:
                continue
            found.set(flat)  # goes on in the state and at the place that the piece before has left, so matches may lie across pieces
            for end, (length, weight) in found:
                if weight:
                    hits.append((end - length, end, weight))
                else:
                    starts.add(end - length)
                    ends.add(end)
        # a phrase is two words, so a word in it begins or ends where it does
        return float(sum(w for a, b, w in hits if a not in starts and b not in ends)), words

    def score(self, text: str | None) -> float:
        total, words = self.evidence(text)
        return float(1 / (1 + np.exp(-np.clip(self.slope * _measure(total, words, self.power) + self.offset, -40, 40))))


def _measure(total: float, words: int, power: float) -> float:
    return float(np.log1p(100 * total / max(1, words) ** power))


def _tail(hits: int, trials: int, share: float) -> float:
    """The logarithm of the chance of `hits` or more among `trials` (Chernoff's bound)."""
    rate = hits / trials
    if rate <= share:
        return 0.0
    rest = (1 - rate) * np.log((1 - rate) / (1 - share)) if rate < 1 else 0.0
    return -trials * (rate * np.log(rate / share) + rest)


def fit(texts: list[str], labels: list[int]) -> Model:
    """The model for labelled texts. With one label only there is no lexicon, and every text has the same low score."""
    one: dict[str, str] = {}  # each word is held once, however often it comes
    toxic, clean = ([[one.setdefault(w, w) for w in folded(t).split()] for t, y in zip(texts, labels, strict=True) if bool(y) is kind] for kind in (True, False))
    with_word, benign = (Counter(w for words in several for w in set(words)) for several in (toxic, clean))
    if not toxic or not clean:
        return Model({}, [])

    def odds(n: int, w: str) -> float:
        return np.log((n + 0.5) / (len(toxic) + 1)) - np.log((benign[w] + 0.5) / (len(clean) + 1))

    # contexts can only lower a word's number, so words that are too few without them need none
    contexts: dict[str, set[int]] = {w: set() for w, n in with_word.items() if odds(n, w) > np.log(5)}
    few: dict[str, set[int]] = {w: set() for w in with_word}
    for words in toxic:
        for a, w, b in zip(["", *words], words, [*words[1:], ""], strict=False):
            if w in contexts:
                contexts[w].add(hash((a, b)))
            if len(few[w]) < 3:
                few[w].add(hash((a, b)))
    enough = sum(len(several) >= 3 for several in few.values())
    share = len(toxic) / (len(toxic) + len(clean))
    limit = np.log(CHANCE / max(1, enough))
    weights = {}
    for w in (w for w in contexts if len(contexts[w]) >= 3):
        n = min(len(contexts[w]), with_word[w])
        if odds(n, w) > np.log(5) and _tail(n, n + benign[w], share) <= limit:
            weights[w] = float(min(odds(n, w), 8.0))
    del few, contexts, one
    phrases, forbidden = Counter(), set()
    for of_toxic, several in ((True, toxic), (False, clean)):
        for words in several:
            found = set()
            for i, w in enumerate(words):
                if w in weights:
                    found |= {f"{a} {b}" for a, b in (words[max(0, i - 1) : i + 1], words[i : i + 2]) if a and b} if 0 < i < len(words) - 1 else set()
            forbidden |= found if of_toxic else set()
            phrases.update(() if of_toxic else found)
    exceptions = sorted(p for p, n in phrases.items() if n >= EXCEPTION_TEXTS and p not in forbidden)
    model = Model(weights, exceptions)
    seen, y = [model.evidence(t) for t in texts], np.array(labels, np.float64)
    best = None
    for power in POWERS:
        x = np.array([_measure(total, n, power) for total, n in seen])
        slope, offset, loss = _logistic(x, y)
        if best is None or loss < best[0] - 1e-9:
            best = (loss, power, slope, offset)
    _, model.power, model.slope, model.offset = best
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Slope, offset and loss of a logistic curve, by Newton's steps; both labels have the same weight."""
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    centre, scale = x.mean(), x.std() + 1e-9
    z = np.stack(((x - centre) / scale, np.ones_like(x)), axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (weight * (p - y)) + ridge * b)
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    logit = z @ b
    loss = float((weight * np.logaddexp(0, np.where(y > 0, -logit, logit))).mean())
    return float(b[0] / scale), float(b[1] - b[0] * centre / scale), loss


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fits on about `SAMPLE_ROWS` labelled rows of each label outside the held-out fold, on fewer if their texts exceed `SAMPLE_CHARS`."""
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).where(fold(id_column, FOLDS) != HELD_OUT)
    known = known.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("y"))
    chosen = bounded_sample(known, "id", "y", SAMPLE_ROWS).dropDuplicates(["id"])
    rows = sampled_texts(docs, chosen, id_column, text_column, SAMPLE_CHARS)
    return fit(rows["text"].tolist(), rows["y"].tolist())


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id long, held_out boolean, score double, predicted int), one row for each row of `docs`.

    Null and empty texts have the score of a text without matches; a null id stays null and counts as empty text for its
    fold; equal texts score equally; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), (fold(id_column, FOLDS) == HELD_OUT).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    scored = arrow_map(rows, run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))
