"""Inputs beyond the sizes of the tables, where an operator once did less than its whole job."""

import numpy as np

from kinloom.llm import langid, simhash, toxicity
from kinloom.llm.common import table
from kinloom.llm.textparts import PART


def test_toxicity_counts_every_part_of_a_long_text():
    model = toxicity.Model({"bad": 2.0}, ["not bad"])
    filler = "calm words "
    near = filler * (PART // len(filler))  # one piece, a little shorter than PART
    for toxic, at in (("bad ", 1), ("bad ", 2), ("bad ", 3)):
        pieces = [near, near, near, near]
        pieces[at] = toxic + pieces[at]
        text = "".join(pieces)
        assert len(text) > 2_000_000 and model.evidence(text) == (2.0, len(text.split()))
    # an exception phrase and a word that lie across the end of a piece
    assert model.evidence("x" * (PART - 4) + " not bad") == (0.0, 3)
    assert model.evidence("x" * (PART - 3) + " bad") == (2.0, 2)
    rng = np.random.default_rng(1)
    text = " ".join(rng.choice(["bad", "not", "calm", "ünï", "漢字", "!"], 500_000))
    words = [w for w in text.split() if w != "!"]
    hits = sum(w == "bad" and v != "not" for v, w in zip(["", *words], words, strict=False))
    fold = {w: toxicity.folded(w).strip() for w in set(words)}
    assert model.evidence(text) == (2.0 * hits, len(words)) and toxicity.folded(text) == f" {' '.join(fold[w] for w in words)} "


def test_language_rejects_texts_of_unlearned_languages_of_any_length(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.learn(docs)
    rng = np.random.default_rng(1)
    for first, letters in ((0x61, 26), (0x3B1, 25), (0x430, 32), (0x4E00, 3000)):
        for words in (10, 30, 100, 300, 1000, 3000, 10_000):
            text = " ".join("".join(map(chr, rng.integers(first, first + letters, n))) for n in rng.integers(2, 9, words))
            assert model.predict([text])[2][0], (first, words)
    rows = [r for r in docs.collect() if r.text and r.lang]
    unlearned = langid.learn(docs.where("lang != 'de'"))
    for words in (10, 100, 300):
        texts = [" ".join(r.text.split()[:words]) for r in rows if r.lang == "de" and len(r.text.split()) >= words]
        assert len(texts) > 20 and np.mean(unlearned.predict(texts)[2]) > 0.8, words
    assert np.mean(model.predict([r.text for r in rows])[2]) < 0.02


def test_keep_one_keeps_different_texts_of_one_id(spark):
    one, two, three = ("a long walk through the old town by night", "seven ships left harbour before the storm came", "prices of grain rose again in early spring")
    rows = [(1, one), (5, one), (5, two), (5, three), (5, three), (7, two), (9, None), (9, None), (None, two)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, one), (5, two), (5, three), (9, None), (None, two)], key=str)
