"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes words that no piece of the vocabulary crosses. The new words of a batch are laid out in one flat numpy
array of symbols. A round finds in each word the least rank of its adjacent pairs (the rank of the piece that a pair
makes; equal scores share a rank), merges all leftmost occurrences of it at once, and compacts the array, until no
pair of the vocabulary remains. Where the reference order (best score first, then leftmost) could differ from merging
all occurrences at once, because a merge opens a pair of the same or a better rank, that word merges only its leftmost
occurrence in that round. Words longer than `LONG` symbols go through the same order with a heap.

Decoding gathers the pieces' bytes by id, joins runs of byte pieces as UTF-8 and drops the space that encoding put first.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .ragged import runs

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
LONG = 512
KEPT_WORDS = 500_000
ROUND_WORDS = 32_768
PART = 1 << 22
NO_RANK = np.int32(2**31 - 1)


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("kinloom-each-byte", _each_byte)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at, size = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < size:
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        else:
            length = {1: 8, 5: 4}.get(wire)
            length = varint() if length is None else length
            yield number, data[at : at + length]
            at += length


class Pieces:
    """A BPE model file: its vocabulary and the tables that merge rounds and decoding use."""

    def __init__(self, model_file: str):
        with open(model_file, "rb") as file:
            model = file.read()
        pieces, scores, kinds = [], [], []
        self.dummy_prefix, self.escape, extra, charsmap, model_type, unknown = True, True, True, b"", 1, " ⁇ "
        for number, value in _fields(model):
            if number == 1:
                entry = dict(_fields(value))
                pieces.append(entry.get(1, b"").decode())
                scores.append(float(np.frombuffer(entry[2], "<f4")[0]) if 2 in entry else 0.0)
                kinds.append(entry.get(3, NORMAL))
            elif number == 2:
                entry = dict(_fields(value))
                model_type, unknown = entry.get(3, 1), entry.get(44, unknown.encode()).decode()
                if entry.get(24, 0):
                    raise ValueError("white space as suffix is not supported")
            elif number == 3:
                entry = dict(_fields(value))
                charsmap, self.dummy_prefix = entry.get(2, b""), bool(entry.get(3, 1))
                extra, self.escape = bool(entry.get(4, 1)), bool(entry.get(5, 1))
        if model_type != 2 or charsmap or extra or not self.escape or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with identity normalisation and without user-defined or unused pieces are supported")
        self.size, self.unknown = len(pieces), kinds.index(UNKNOWN)
        self.kinds = np.array(kinds, np.int8)
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        self.byte_ids = np.full(256, -1, np.int32)
        for i, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
        self.byte_fallback = bool((self.byte_ids >= 0).all())
        # A cut before the space sign is exact as no piece has it after another character.
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that cross a space are not supported")
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[scores[i]] for p, i in self.ids.items()}
        self._pair_tables(pieces)
        surface = [b"" if k == CONTROL else unknown.encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.fromiter(map(len, surface), np.int64, self.size)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.starts_with_space = np.fromiter((k == NORMAL and p.startswith(SPACE) for p, k in zip(pieces, kinds, strict=True)), bool, self.size)
        self.is_control = self.kinds == CONTROL

    def _pair_tables(self, pieces: list[str]) -> None:
        """All pairs of symbols whose text is a piece, with that piece, and the pieces' ranks."""
        keys, made = [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                # a character that is no piece itself can not be part of one that merging reaches
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(i)
        ranks = np.full(self.size, NO_RANK, np.int32)
        for piece, i in self.ids.items():
            ranks[i] = self.rank[piece]
        self.pair_table = _HashTable(np.array(keys, np.int64), np.array(made, np.int32))
        self.piece_rank = np.append(ranks, NO_RANK)
        # single characters outside the vocabulary that still occur inside pieces
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        if inside - self.ids.keys():
            raise ValueError("a piece holds a character that is no piece")

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) that each pair makes; NO_RANK where it makes none."""
        made = self.pair_table.get(np.where((left < 0) | (right < 0), -1, left << 32 | right))
        return self.piece_rank[made], made

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word; words are as `words_of` gives them."""
        result: list[np.ndarray | None] = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i in set(range(len(words))) - set(short):
            result[i] = self._by_heap(words[i])
        flat = "".join(words[i] for i in short)
        lengths = np.fromiter((len(words[i]) for i in short), np.int64, len(short))
        chars = np.frombuffer(flat.encode("utf-32-le"), "<u4")
        kinds, back = np.unique(chars, return_inverse=True)
        known = np.array([self.ids.get(chr(c), -1) for c in kinds], np.int64)
        # characters outside the vocabulary are negative symbols and never merge
        symbol = np.where(known < 0, -1 - kinds.astype(np.int64), known)[back] if len(chars) else np.empty(0, np.int64)
        word = np.repeat(np.arange(len(short)), lengths)
        done_symbols, done_words = [], []
        if len(symbol):
            rank, made = self._pairs(symbol[:-1], symbol[1:])
            rank, made = np.append(rank, NO_RANK), np.append(made, -1)
            rank[np.flatnonzero(word[1:] != word[:-1])] = NO_RANK
        while len(symbol):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(symbol)))
            # words in which no pair is left are done
            active = least < NO_RANK
            if not active.all():
                stay = np.repeat(active, size)
                done_symbols.append(symbol[~stay])
                done_words.append(word[~stay])
                symbol, word, rank, made = symbol[stay], word[stay], rank[stay], made[stay]
                least, size = least[active], size[active]
                if not len(symbol):
                    break
            number = np.repeat(np.arange(len(size)), size)
            hit = _leftmost(rank == least[number])
            several = np.bincount(number[hit], minlength=len(size)) > 1
            if several.any():
                unsafe = self._unsafe(symbol, number, made, hit, least, several)
                if unsafe.any():
                    at = np.flatnonzero(hit)
                    first = np.concatenate(([True], number[at][1:] != number[at][:-1]))
                    hit[at[~first & unsafe[number[at]]]] = False
            symbol[hit] = made[hit]
            keep = np.concatenate(([True], ~hit[:-1]))
            symbol, word, rank, made, hit = symbol[keep], word[keep], rank[keep], made[keep], hit[keep]
            # only the pairs that a merged symbol is part of are new
            fresh = hit.copy()
            fresh[:-1] |= hit[1:]
            fresh[-1] = False
            fresh[:-1] &= word[1:] == word[:-1]
            rank[hit], made[hit] = NO_RANK, -1
            at = np.flatnonzero(fresh)
            rank[at], made[at] = self._pairs(symbol[at], symbol[at + 1])
        if done_symbols:
            symbol, word = np.concatenate(done_symbols), np.concatenate(done_words)
            order = np.argsort(word, kind="stable")
            symbol, word = symbol[order], word[order]
        symbol, word = self._fallback(symbol, word)
        cuts = np.searchsorted(word, np.arange(len(short) + 1))
        ids = symbol.astype(np.int32)
        for k, i in enumerate(short):
            result[i] = ids[cuts[k] : cuts[k + 1]]
        return result

    def _unsafe(self, symbol: np.ndarray, number: np.ndarray, made: np.ndarray, hit: np.ndarray, least: np.ndarray, several: np.ndarray) -> np.ndarray:
        """Words in which merging all hits at once could differ from merging them one after the other."""
        unsafe = np.zeros(len(least), bool)
        look = several[number]
        after = np.where(hit, made, symbol)
        gone = np.concatenate(([False], hit[:-1]))
        kept = np.flatnonzero(~gone & look)
        if len(kept) > 1:
            # pairs as they are after all merges
            same = number[kept][1:] == number[kept][:-1]
            fresh = (hit[kept][1:] | hit[kept][:-1]) & same
            rank, _ = self._pairs(after[kept][:-1], after[kept][1:])
            bad = fresh & (rank <= least[number[kept][:-1]])
            unsafe[number[kept][:-1][bad]] = True
        # a merged symbol beside the left part of a hit that is yet to merge
        at = np.flatnonzero(hit & look)
        at = at[at + 2 < len(symbol)]
        at = at[hit[at + 2] & (number[at + 2] == number[at])]
        if len(at):
            rank, _ = self._pairs(made[at].astype(np.int64), symbol[at + 2])
            unsafe[number[at][rank <= least[number[at]]]] = True
        return unsafe

    def _fallback(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols outside the vocabulary as byte pieces, or as the unknown piece."""
        odd = np.flatnonzero(symbol < 0)
        if not len(odd):
            return symbol, word
        if not self.byte_fallback:
            symbol = symbol.copy()
            symbol[odd] = self.unknown
            return symbol, word
        coded = [chr(-1 - int(s)).encode() for s in symbol[odd]]
        sizes = np.ones(len(symbol), np.int64)
        sizes[odd] = [len(c) for c in coded]
        out, words = np.repeat(symbol, sizes), np.repeat(word, sizes)
        places = runs((np.cumsum(sizes) - sizes)[odd], sizes[odd])
        out[places] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        return out, words

    def _by_heap(self, text: str) -> np.ndarray:
        """The same order of merges with a heap, for a long word."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[int, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(parts):
                both = parts[left] + parts[right]
                if (rank := self.rank.get(both)) is not None:
                    heapq.heappush(heap, (rank, left, right, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, both = heapq.heappop(heap)
            if parts[left] is None or parts[right] is None or after[left] != right or parts[left] + parts[right] != both:
                continue
            parts[left], parts[right] = both, None
            after[left] = after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        symbol = np.array([self.ids.get(p, -1 - ord(p[0])) for p in parts if p is not None], np.int64)
        return self._fallback(symbol, np.zeros(len(symbol), np.int64))[0].astype(np.int32)

    def words_of(self, text: str) -> list[str]:
        """The text's words, whose ids one after the other are those of the text. All but the first begin with a space
        sign, which is left out where it is the only one, as then it is implied."""
        if not text:
            return []
        flat = text.replace(SPACE, " ")
        if not self.dummy_prefix:
            raise ValueError("models without a dummy prefix are not supported")
        words = flat.split(" ")
        if "" not in words:
            return words
        return [w[1:].replace(" ", SPACE) if w[1:] and not w.startswith("  ") else w.replace(" ", SPACE) for w in re.findall(" +[^ ]*", " " + flat)]

    @staticmethod
    def whole_word(word: str) -> str:
        """A word of `words_of` with its space signs."""
        return word if word.startswith(SPACE) else SPACE + word

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, as the library's decode(ids): control ids give nothing, invalid bytes U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= self.size:
            raise IndexError("piece id is out of range")
        data = self.surface[runs(self.surface_at[ids], self.surface_size[ids])].tobytes()
        shown = np.flatnonzero(~self.is_control[ids])
        if len(shown) and self.starts_with_space[ids[shown[0]]]:
            data = data[1:]
        return data.decode("utf-8", "kinloom-each-byte")


def _leftmost(hit: np.ndarray) -> np.ndarray:
    """Of each run of adjacent hits, whose pairs overlap, the first, third, fifth and so on."""
    at = np.flatnonzero(hit)
    if len(at) < 2:
        return hit
    head = np.concatenate(([True], at[1:] != at[:-1] + 1))
    first = at[head][np.cumsum(head) - 1]
    out = np.zeros(len(hit), bool)
    out[at[(at - first) % 2 == 0]] = True
    return out


class _HashTable:
    """Fixed int64 keys to int32 values, looked up for whole arrays; -1 where a key is not there.

    Each level is an open table; keys whose slot is taken go to the next, smaller level.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        while len(keys):
            bits = max(4, int(len(keys) * 4).bit_length())
            slot = self._slots(keys, len(self.levels), bits)
            _, first = np.unique(slot, return_index=True)
            table, made = np.full(1 << bits, -2, np.int64), np.full(1 << bits, -1, np.int32)
            table[slot[first]], made[slot[first]] = keys[first], values[first]
            self.levels.append((bits, table, made))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    @staticmethod
    def _slots(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        odd = np.uint64((0x9E3779B97F4A7C15 + 2 * level * 0x632BE59BD9B4E019) & (2**64 - 1))
        return ((keys.astype(np.uint64) * odd) >> np.uint64(64 - bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        for level, (bits, table, made) in enumerate(self.levels):
            slot = self._slots(keys, level, bits)
            out = np.where(table[slot] == keys, made[slot], out)
        return out


class Encoder:
    """Encodes texts; keeps the ids of up to `KEPT_WORDS` words, as most words come again."""

    def __init__(self, pieces: Pieces, kept: int = KEPT_WORDS):
        self.pieces, self.kept = pieces, kept
        shown = [f"{i}," for i in range(pieces.size)]
        width = max(map(len, shown))
        self.digits = np.frombuffer("".join(x.ljust(width) for x in shown).encode(), np.uint8).reshape(-1, width)
        self.filled = self.digits != 32
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.at, self.length, self.flat, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(1 << 16, np.int32), 0

    def _learn(self, words: list[str]) -> None:
        found = [x for at in range(0, len(words), ROUND_WORDS) for x in self.pieces.encode_words([Pieces.whole_word(w) for w in words[at : at + ROUND_WORDS]])]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.at = np.concatenate((self.at, self.used + np.cumsum(sizes) - sizes))
        self.length = np.concatenate((self.length, sizes))
        fresh = np.concatenate(found)
        if self.used + len(fresh) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(self.used + 2 * len(fresh), np.int32)))
        self.flat[self.used : self.used + len(fresh)] = fresh
        self.used += len(fresh)

    def encode(self, texts: list[str | None] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, none for null; many texts go in parts of about `PART` characters."""
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
        flat = pc.replace_substring(texts, SPACE, " ")
        # texts without two spaces in a row, or one at an end, are split and their words told apart by Arrow
        plain = pc.invert(pc.match_substring_regex(flat, "^( |$)|  | $"))
        split = pc.split_pattern(flat.filter(plain), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        other = [self.pieces.words_of(t) for t in texts.filter(pc.invert(plain)).to_pylist()]
        if new := set(words).union(*other).difference(self.number):
            self._learn(list(new))
        number = self.number.__getitem__
        plain_ids = self._ids(np.fromiter(map(number, words), np.int64, len(words))[coded.indices.to_numpy()], pc.list_value_length(split).to_numpy())
        other_ids = self._ids(np.fromiter((number(w) for ws in other for w in ws), np.int64), np.fromiter(map(len, other), np.int64))
        for is_plain in plain.to_pylist():
            yield next(plain_ids if is_plain else other_ids)

    def _ids(self, words: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of texts, given their words one after the other and the number of words of each."""
        sizes = self.length[words]
        flat = self.flat[runs(self.at[words], sizes)]
        cuts = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield flat[a:b]

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.digits[ids][self.filled[ids]].tobytes()[:-1]


_ENCODERS: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    """One encoder for a model in each Python worker."""
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = Encoder(Pieces(model_file))
    return _ENCODERS[model_file]


def encode_documents(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens long, ids_sha256, decoded_sha256 string), and with `with_ids` also ids array<int> and decoded.

    One row for each row of `docs`: null and empty texts have no ids, the digests of nothing and an empty decoded text;
    repeated rows and ids repeat, a null id stays null, an empty table gives no rows, other columns are ignored.
    Whole texts are encoded, however long; `model_file` must be readable on the executors.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_file)
        for batch in batches:
            rows: list[list] = [[] for _ in range(3 + 2 * with_ids)]
            for ids in coder.encode(batch.column(1)):
                decoded = coder.pieces.decode(ids)
                found = [len(ids), hashlib.sha256(coder.decimal(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                for column, value in zip(rows, found + [ids, decoded] * with_ids, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=False))], names=names[: len(rows) + 1])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return arrow_map(rows, run, schema)
