"""Best-fit packing of documents into sequences: patterns by non-negative least squares, residuals by best fit.

All that packing has to know is how many pieces have each length, a histogram of at most `CAPACITY` numbers at any size of the
corpus. Patterns are two lengths in any numbers, or three, that fill a sequence exactly; how often each is used is fitted to the histogram by
sparse non-negative least squares and rounded; what is left, and the shorter pieces that were kept back to fill gaps, is
packed best fit decreasing, again by lengths and not by documents. Pieces of a length are numbered (in buckets, so that no
length lies in one task), and their numbers say which place of the plan is theirs.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import arrow_map, written
from .ragged import runs

CAPACITY = 2048
END_ID = 0
BUCKET_ROWS, BUCKETS = 128, 4096
SHORT = 96
PART = 1 << 21
KEPT_WORDS = 600_000
LEARN_WORDS = 4_096
MARK = "\x01"
#: A sign before white space and behind a letter or digit begins a token of its own in the byte-level pattern.
SIGN = (r"([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}])([!-&(-/:-@\[-`{-~][ \n])", rf"\1{MARK}\2")
#: Texts with white space other than single spaces and line feeds inside are encoded whole.
UNEVEN = r"[^\S \n]|[\x01\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|^[ \n]|[ \n]$|[ \n][ \n]"


class TextEncoder:
    """Ids of a tokenizers file. Texts are cut before a space or line feed between other characters and before a sign between a
    letter and white space, where the byte-level pattern always cuts, and pieces seen before are not encoded again.

    New pieces that begin with a space or line feed are encoded as one joined text, and its ids are cut at the tokens that
    begin with one: no piece has another inside. Should the cuts not be as many as the pieces, they are encoded each by itself.
    """

    def __init__(self, tokenizer_file: str, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.kept = Tokenizer.from_file(tokenizer_file), kept
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[n for token, n in vocabulary.items() if token[:1] in ("\u0120", "\u010a")]] = True  # byte-level names of space and line feed
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.at, self.length, self.flat, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(1 << 16, np.uint32), 0

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that begin with a space or line feed."""
        flat = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        starts = np.flatnonzero(self.begins[flat])
        return (np.diff(np.append(starts, len(flat))), flat) if len(starts) == len(words) and starts[0] == 0 else self._each(words)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [self._each([text])[1] for text in texts]

    def _learn(self, words: list[str]) -> None:
        """Keeps the ids of new words, which all begin with a space or line feed, or none does."""
        sizes, flat = [], []
        # the library's results are large, so few are held at a time
        for at in range(0, len(words), LEARN_WORDS):
            some = words[at : at + LEARN_WORDS]
            coded = self._joined(some) if some[0][:1] in (" ", "\n") else self._each(some)
            sizes.append(coded[0])
            flat.append(coded[1])
        size, fresh = np.concatenate(sizes), np.concatenate(flat)
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.at = np.concatenate((self.at, self.used + np.cumsum(size) - size))
        self.length = np.concatenate((self.length, size))
        if self.used + len(fresh) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(self.used + 2 * len(fresh), np.uint32)))
        self.flat[self.used : self.used + len(fresh)] = fresh
        self.used += len(fresh)

    def encode(self, texts: list[str | None] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, none for null; many texts go in parts of about `PART` bytes."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, side="right")))
            yield from self._part(texts.slice(at, end - at))
            at = end

    def _part(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if len(self.number) > self.kept:
            self._clear()
        even = pc.invert(pc.match_substring_regex(texts, UNEVEN))
        marked = pc.replace_substring_regex(texts.filter(even), *SIGN)
        marked = pc.replace_substring(pc.replace_substring(marked, " ", MARK + " "), "\n", MARK + "\n")
        split = pc.split_pattern(marked, MARK)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.number]
        for some in ([w for w in new if w[:1] in (" ", "\n")], [w for w in new if w[:1] not in (" ", "\n")]):
            if some:
                self._learn(some)
        place = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        sizes = self.length[place]
        flat = self.flat[runs(self.at[place], sizes)]
        texts_end = np.cumsum(pc.list_value_length(split).to_numpy())
        cuts = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], texts_end)).astype(np.int64)].tolist()
        even_ids = (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        other_ids = iter(self._whole(texts.filter(pc.invert(even)).to_pylist()))
        for is_even in even.to_pylist():
            yield next(even_ids if is_even else other_ids)


_ENCODERS: dict[str, TextEncoder] = {}


def cut(size: int, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of a document's pieces: all have `capacity` ids but the first, which has what is left."""
    starts = np.arange(size % capacity or min(size, capacity), size, capacity, dtype=np.int64)
    starts = np.concatenate((np.zeros(1, np.int64), starts))
    return starts, np.diff(np.append(starts, size))


def pieces(docs: DataFrame, tokenizer_file: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids_crc32 long) of each document's pieces, and ids array<long> if asked."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _ENCODERS:
            _ENCODERS[tokenizer_file] = TextEncoder(tokenizer_file)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, ids in zip(batch.column(0).to_pylist(), _ENCODERS[tokenizer_file].encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for k, (a, n) in enumerate(zip(*(x.tolist() for x in cut(len(ids), capacity)), strict=True)):
                    row = [doc_id, k, a, n, zlib.crc32(ids[a : a + n].tobytes())] + [ids[a : a + n].tolist()] * with_ids
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names=names)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return arrow_map(rows, run, schema)


def patterns(left: np.ndarray, capacity: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, times): every way to fill a sequence exactly with pieces of two lengths in any numbers or of three lengths once each.

    Lengths are those from `least` on of which `left` has pieces, in the numbers that it has; rows of three, 0 where there is none.
    """
    has = left > 0
    has[:least] = False
    has[capacity:] = False
    present = np.flatnonzero(has)
    lengths, times = [np.zeros((0, 3), np.int64)], [np.zeros((0, 3), np.int64)]

    def add(a: int, i: int, b: np.ndarray, j: np.ndarray) -> None:
        lengths.append(np.stack((np.full_like(b, a), b, np.zeros_like(b)), axis=1))
        times.append(np.stack((np.full_like(b, i), j, np.zeros_like(b)), axis=1))

    for a in present.tolist():
        for i in range(1, min(capacity // a, int(left[a])) + 1):
            rest = capacity - i * a
            if not rest:
                add(a, i, np.zeros(1, np.int64), np.zeros(1, np.int64))
                continue
            j = np.arange(1, rest // (a + 1) + 1)
            j = j[rest % j == 0]
            j = j[has[rest // j] & (left[rest // j] >= j)]
            add(a, i, rest // j, j)
    for a in present[3 * present < capacity].tolist():
        b = present[(present > a) & (2 * present < capacity - a)]
        b = b[has[capacity - a - b]]
        lengths.append(np.stack((np.full_like(b, a), b, capacity - a - b), axis=1))
        times.append(np.ones((len(b), 3), np.int64))
    return np.concatenate(lengths), np.concatenate(times)


def _solve(lengths: np.ndarray, times: np.ndarray, target: np.ndarray, x: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(non-negative x closest to `target`, what is left of it), by accelerated projected gradient from `x`."""
    use = lambda v: np.bincount(lengths.ravel(), weights=(times * v[:, None]).ravel(), minlength=len(target))
    back = lambda r: (r[lengths] * times).sum(axis=1)
    probe = np.ones(len(lengths))
    for _ in range(10):  # the largest eigenvalue gives the step
        probe = back(use(probe))
        most = np.linalg.norm(probe)
        probe /= most
    y, pace = x, 1.0
    for _ in range(rounds):
        z = np.maximum(0, y - back(use(y) - target) / (1.05 * most))
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        y = z + (pace - 1) / faster * (z - x)
        x, pace = z, faster
    return x, target - use(x)


def fit_counts(lengths: np.ndarray, times: np.ndarray, target: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(active patterns, their counts): a sparse non-negative least-squares fit of the patterns' pieces to the histogram `target`.

    Active sets: in each round those patterns enter that the residual asks for most, at most one for each length, the
    problem is solved for the active ones, and those with a count of zero leave.
    """
    norm = np.sqrt((times * times).sum(axis=1))
    active, x, residual = np.empty(0, np.int64), np.empty(0), target
    for _ in range(rounds):
        gain = (residual[lengths] * times).sum(axis=1) / norm
        gain[active] = 0
        order = np.flatnonzero(gain > 0.5)
        order = order[np.argsort(-gain[order], kind="stable")]
        free, fresh = np.ones(len(target), bool), []
        while len(order):  # the best whose lengths are all free, then the next, by portions
            for p, (a, b, c) in zip(order[:2048].tolist(), lengths[order[:2048]].tolist(), strict=True):
                if free[a] and free[b] and free[c]:
                    fresh.append(p)
                    free[[a, b, c]] = False
                    free[0] = True  # stands for no length
            order = order[2048:]
            order = order[free[lengths[order]].all(axis=1)]
        if not fresh:
            break
        active, x = np.concatenate((active, np.array(fresh))), np.concatenate((x, np.zeros(len(fresh))))
        x, residual = _solve(lengths[active], times[active], target, x)
        active, x = active[x > 1e-6], x[x > 1e-6]
    return active, x


def plan_patterns(left: np.ndarray, capacity: int, least: int = 1) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences have them) by patterns; their pieces are taken from `left`.

    Counts are fitted, rounded (to 1 at least) and taken from the largest on, but never more than there are; what rounding leaves is fitted anew
    until a fit places less than a hundredth of the pieces.
    """
    result, total = [], int(left.sum())
    while True:
        lengths, times = patterns(left, capacity, least)
        if not len(lengths):
            return result
        target = left.astype(np.float64)
        target[:least] = 0
        active, x = fit_counts(lengths, times, target)
        placed = 0
        for k in np.argsort(-x, kind="stable").tolist():
            of, many = lengths[active[k]], times[active[k]]
            of, many = of[many > 0], many[many > 0]
            n = min(max(1, int(round(x[k]))), int((left[of] // many).min()))
            if n:
                left[of] -= n * many
                placed += n * int(many.sum())
                result.append((tuple(np.repeat(of, many).tolist()), n))
        if placed * 100 < total:
            return result


def plan(histogram: dict[int, int], capacity: int = CAPACITY, short: int = SHORT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences have them): every piece of the histogram has a place.

    Pieces below `short`, or below the median of the pieces that fill no sequence if this is less, are kept back from the patterns,
    as they fill the gaps of what the patterns leave.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    result = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    if left.any():
        median = int(np.searchsorted(np.cumsum(left), (left.sum() + 1) // 2))
        result += plan_patterns(left, capacity, min(short, median))
    return result + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing of `left[length]` pieces of each length; sequences with the same lengths are one entry."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    free = np.zeros(capacity + 1, bool)

    def put(space: int, lengths: tuple[int, ...], n: int) -> None:
        room[space][lengths] = room[space].get(lengths, 0) + n
        free[space] = True

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fits = np.flatnonzero(free[length:])
            space = length + int(fits[0]) if len(fits) else None
            if space is None:
                each = capacity // length
                if whole := n // each:
                    put(capacity - each * length, (length,) * each, whole)
                if n % each:
                    put(capacity - n % each * length, (length,) * (n % each), 1)
                break
            lengths, have = next(iter(room[space].items()))
            used = min(n, have)
            if used == have:
                del room[space][lengths]
                free[space] = bool(room[space])
            else:
                room[space][lengths] = have - used
            put(space - length, (*lengths, length), used)
            n -= used
    return [(lengths, n) for space in sorted(room) for lengths, n in room[space].items()]


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length: `key` (length and first number of a run of pieces), and the run's first sequence and offset."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, n in planned:
        offset = 0
        for length in lengths:
            rows.append((length << 44 | used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return {"key": table[:, 0], "sequence": table[:, 1], "offset": table[:, 2]}


def pack(docs: DataFrame, tokenizer_file: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece of each row of `docs`.

    Null and empty texts are one piece with the end id alone; a null id stays null; repeated rows are packed each; an empty table
    gives no rows; other columns are ignored. Only documents longer than a sequence are cut.
    """
    cuts = written(pieces(docs, tokenizer_file, id_column, text_column, capacity), "pieces")
    histogram = dict(cuts.groupBy("length").count().collect())  # `capacity` rows at most
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))

    buckets = np.ones(capacity + 1, np.int64)
    for length, n in histogram.items():
        buckets[length] = min(BUCKETS, max(1, n // BUCKET_ROWS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            several = buckets[batch.column("length").to_numpy(zero_copy_only=False)]
            bucket = batch.column("mix").to_numpy(zero_copy_only=False).view(np.uint64) % several.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bucket.astype(np.int32))], names=[*batch.schema.names[:-1], "bucket"])

    mixed = cuts.withColumn("mix", F.xxhash64("doc_id", "piece", "ids_crc32"))
    dealt = arrow_map(mixed, deal, "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int")
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("number", F.row_number().over(order)).join(sizes, ["length", "bucket"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number") - 1).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            key = batch.column("length").to_numpy(zero_copy_only=False) << 44 | batch.column("number").to_numpy(zero_copy_only=False)
            at = np.searchsorted(table["key"], key, side="right") - 1
            sequence = table["sequence"][at] + key - table["key"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(table["offset"][at])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return arrow_map(numbered, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
