"""Scores, counts, plans and readers against plain re-statements of what they compute."""

import io
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from kinloom.llm import langid, lines, packing, quality, sentencepieces, toxicity, warc


def member(body):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


def test_warc_goes_on_behind_a_damaged_record():
    good = lambda n: warc.record(n, "u", b"payload %d" % n, None)
    short = member(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nlonger than that\r\n\r\n")
    plain = b"HTTP/1.1 200 OK"
    http = member(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(plain) + plain + b"\r\n\r\n")
    rows = list(warc.read_records(io.BytesIO(good(1) + short + member(b"no header") + http + good(2)), True))
    assert [r["error"] is None for r in rows] == [True, False, False, True, True]
    assert rows[3]["payload"] == plain and rows[3]["payload_bytes"] == len(plain) and rows[4]["payload"] == b"payload 2"
    cut = list(warc.read_records(io.BytesIO(good(1) + good(2)[:-20])))
    assert cut[0]["error"] is None and cut[-1]["error"]


def test_toxicity_counts_words_outside_exception_phrases():
    model, maker = toxicity.Model({"vile": 2.0, "rotten": 1.5}, ["rotten egg", "not vile"]), random.Random(5)
    for _ in range(300):
        words = maker.choices(["vile", "rotten", "egg", "not", "fine", "viler", "V1LE", "R0TTEN", "\U0001d5cb\U0001d5c8\U0001d5cd\U0001d5cd\U0001d5be\U0001d5c7", "\U0001f600"], k=maker.randint(0, 12))
        plain = [toxicity.folded(w).strip() for w in words]
        plain = [w for w in plain if w]
        fold = {toxicity.folded(k).strip(): v for k, v in model.weights.items()}
        phrases = {tuple(toxicity.folded(p).split()) for p in model.exceptions}
        folded = toxicity.Model({k: v for k, v in fold.items()}, [" ".join(p) for p in phrases])
        total = sum(fold[w] for i, w in enumerate(plain) if w in fold and tuple(plain[max(0, i - 1) : i + 1]) not in phrases and tuple(plain[i : i + 2]) not in phrases)
        assert folded.evidence(" ".join(words)) == (total, len(plain))
    assert toxicity.folded("\U0001d5cb\U0001d5c8\U0001f600\U000e0041x") == " ro x "


def test_toxicity_takes_many_repeats_of_a_phrase():
    model = toxicity.Model({"viie": 1.0}, ["viie cake"])
    assert model.evidence("viie cake " * 20_000) == (0.0, 40_000)


def test_quality_features_are_sums_over_words():
    table = np.random.default_rng(1).normal(size=(2 << quality.BITS, quality.SIZE)).astype(np.float32)
    texts = ["one two two three", "", None, "x", "A b, C d. " * 50, "x"]
    found = quality.Pooled(table).features(texts)
    for text, row in zip(texts, found, strict=True):
        data = np.frombuffer((text or "").encode() + b"\n", np.uint8)
        _, by_hash, shape = quality.word_rows(data)
        v = (table[by_hash] + table[shape]).astype(np.float64)
        if not len(v):
            assert not row.any()
            continue
        mean, spread = v.mean(axis=0), np.sqrt(np.maximum((v * v).mean(axis=0) - v.mean(axis=0) ** 2, 0))
        pairs = [(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) for a, b in itertools.pairwise(v)]
        same = [x == y for x, y in itertools.pairwise(by_hash)]
        want = [*mean, *spread, np.linalg.norm(mean), sum(pairs) / max(1, len(pairs)), sum(same) / max(1, len(same)), np.log1p(len(v))]
        assert np.allclose(row, want, rtol=1e-3, atol=1e-3)
    assert (found[3] == found[5]).all()


def test_language_counts_are_letter_trigrams():
    for text in ("Ein Haus", "a1b  c", "日本語 \U00020000\U00020001", "\U0001f600x\U0001f600", "straße É", ""):
        flat = "".join(c if c.isalpha() else " " for c in text.lower())
        flat = " " + " ".join(flat.split()) + " "
        want = Counter()
        for a, b, c in zip(flat, flat[1:], flat[2:], strict=False):
            key = ord(a) << 42 | ord(b) << 21 | ord(c)
            want[(key * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> 52] += 1
        found = langid.counts([text])[0]
        assert {i: int(n) for i, n in enumerate(found) if n} == dict(want)


def fewest(pieces, capacity):
    """The least number of sequences, by trying all."""
    best = len(pieces)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(pieces):
            best = len(room)
            return
        for k in {r: j for j, r in enumerate(room)}.values():
            if room[k] >= pieces[i]:
                place(i + 1, [*room[:k], room[k] - pieces[i], *room[k + 1 :]])
        place(i + 1, [*room, capacity - pieces[i]])

    place(0, [])
    return best


def test_packing_plan_is_near_the_fewest_sequences():
    maker = random.Random(2)
    for _ in range(150):
        pieces = sorted((maker.randint(1, 24) for _ in range(maker.randint(1, 9))), reverse=True)
        planned = packing.plan(Counter(pieces), 24, 4)
        held = Counter()
        for lengths, n in planned:
            assert sum(lengths) <= 24
            held.update({x: n * c for x, c in Counter(lengths).items()})
        assert held == Counter(pieces)
        assert sum(n for _, n in planned) <= fewest(pieces, 24) + 1


def test_patterns_are_all_exact_fills():
    left = np.array([0, 4, 2, 0, 3, 1, 0, 1, 0])
    lengths, times = packing.patterns(left, 8)
    assert ((lengths * times).sum(axis=1) == 8).all()
    want = set()
    for counts in itertools.product(*(range(int(n) + 1) for n in left)):
        used = [(x, n) for x, n in enumerate(counts) if n]
        if sum(x * n for x, n in used) == 8 and (len(used) <= 2 or (len(used) == 3 and all(n == 1 for _, n in used))):
            want.add(frozenset(used))
    assert {frozenset((int(a), int(n)) for a, n in zip(x, t, strict=True) if n) for x, t in zip(lengths, times, strict=True)} == want


def test_sentencepiece_words_of_any_length():
    path, maker = public_tokenizers.path("piece_bpe_32k.model"), random.Random(3)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.Pieces(path)
    for size in (511, 512, 513, 20_000):
        for letters in ("etaoinshrdlu", "a", "漢字かな", "ab▁ "):
            text = "".join(maker.choices(letters, k=size))
            words = [own.whole_word(w) for w in own.words_of(text)]
            assert np.concatenate(own.encode_words(words)).tolist() == library.encode(text)


def test_boilerplate_of_sites_of_every_size(spark):
    rows = [("nine", f"menu\nbody {i}") for i in range(9)] + [("one", "menu\nbody")] + [("two", "menu\nx"), ("two", "other\ny")] + [("many", f"menu\npage {i}" if i < 50 else f"page {i}") for i in range(300)] + [("rare", f"menu\npage {i}" if i < 15 else f"page {i}") for i in range(300)]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    lost = {r.source: r.n for r in lines.drop_boilerplate(docs).groupBy("source").agg({"n_dropped": "sum"}).withColumnRenamed("sum(n_dropped)", "n").collect()}
    assert lost == {"nine": 9, "one": 0, "two": 0, "many": 50, "rare": 0}
