"""Every operator against brute force or the library it must equal, and on a small table with nulls, empty and repeated texts."""

import hashlib
import sys
import zlib
from base64 import b32encode
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import oracle_rows, spark_rows  # noqa: E402

from kinloom.llm import langid, lines, neighbours, packing, quality, queries, sentencepieces, simhash, tiff, toxicity, warc  # noqa: E402
from kinloom.llm.common import table  # noqa: E402

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TEXTS = [None, "", " ", "one", "one two three", "a b c d e", "A B C D E", "tab\tand\nline  two spaces ", "ünï çödé 漢字 \U0001f600", "same text again here", "same text again here", "word " * 30_000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated and very long texts, a repeated row, a null id, and columns with the names of results."""
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), 7, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "no id here", None, None, 10, 7, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, n_dropped string").cache()


def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def test_warc(spark):
    pages = {r.page_id: (r.html or "").encode() for r in table(spark, MIDDLE, "pages").collect()}
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    want = {(k, len(p), b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == k else "revisit", None if first[p] == k else first[p]) for k, p in pages.items()}
    assert {tuple(r) for r in queries.op1_warc(spark, MIDDLE).collect()} == want


def test_warc_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, 0), (2, "u", "", 0), (3, "u", "x", 0), (4, "u", "x", 0)], "page_id long, url string, html string, payload int")
    found = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()}
    assert found == {1: (0, "response", None), 2: (0, "revisit", 1), 3: (1, "response", None), 4: (1, "revisit", 3)}
    assert warc.archive_pages(pages.limit(0)).collect() == []


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    """Each id's smallest reachable id, by comparing all distinct fingerprints."""
    distinct = np.array(sorted(set(prints.values())), np.uint64)
    least = {int(f): min(i for i, p in prints.items() if p == f) for f in distinct}
    label = np.array([least[int(f)] for f in distinct])
    while True:
        new = np.array([label[np.bitwise_count(distinct ^ f) <= 4].min() for f in distinct])
        if (new == label).all():
            return {i: int(label[np.searchsorted(distinct, np.uint64(p))]) for i, p in prints.items()}
        label = new


@pytest.mark.parametrize("point_rows", [simhash.POINT_ROWS, 3])
def test_simhash(spark, point_rows):
    prints = {i: plain_fingerprint(t) for i, t in texts(spark, MIDDLE).items()}
    groups = plain_groups(prints)
    found = simhash.near_duplicates(table(spark, MIDDLE, "documents"), point_rows=point_rows).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {(i, f"{p:016x}", groups[i]) for i, p in prints.items()}


def test_simhash_odd(spark, odd):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(TEXTS) + 2
    of = {r.doc_id: r for r in found}
    assert of[0].fingerprint == "0" * 16 and of[0].component_id == of[1].component_id == of[2].component_id == 0
    assert of[6].component_id == 5 and of[10].component_id == 9
    assert all(of[i].fingerprint == f"{plain_fingerprint(t):016x}" for i, t in enumerate(TEXTS))
    assert simhash.near_duplicates(odd.limit(0)).collect() == []


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_sentencepiece(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)

    def want(i, text):
        ids = library.encode(text or "")
        return i, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode())

    found = queries.op3_sentencepiece(spark, MIDDLE).collect()
    assert {tuple(r) for r in found} == {want(i, t) for i, t in texts(spark, MIDDLE).items()}
    found = {tuple(r) for r in sentencepieces.encode_documents(odd, path).collect()}
    assert found == {want(i, t) for i, t in enumerate(TEXTS)} | {want(None, "no id here")}
    assert sentencepieces.encode_documents(odd.limit(0), path).collect() == []


def test_tiff(spark, odd):
    def want(i, text):
        data = (text or "").encode()
        padded = data + b" " * (-len(data) % 192 if data else 192)
        return i, len(data), len(padded), sha(padded), zlib.crc32(padded[-16:])

    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    assert {tuple(r) for r in queries.op4_media_tiff(spark, MIDDLE).select(*columns).collect()} == {want(i, t) for i, t in texts(spark, MIDDLE).items()}
    assert {tuple(r) for r in tiff.store_and_read(odd).select(*columns).collect()} == {want(i, t) for i, t in enumerate(TEXTS)} | {want(None, "no id here")}
    assert tiff.store_and_read(odd.limit(0)).collect() == []


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, predictor):
    maker = np.random.default_rng(1)
    pages = [maker.integers(0, 3, (2050, 64, 3), dtype=np.uint8), np.zeros((1, 64, 3), np.uint8)]
    read = list(tiff.read_tiff(tiff.write_tiff(pages, compression, predictor)))
    assert len(read) == 2 and all((page.pixels == want).all() for page, want in zip(read, pages, strict=True))


def check_packed(rows, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in documents.items()}
    pieces, sequences = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for i, found in pieces.items():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found))) and [s for _, s, _ in found] == np.cumsum([0] + [n for _, _, n in found[:-1]]).tolist()
        assert sum(n for _, _, n in found) == len(ids[i]) and (len(found) == 1 or all(n == 2048 for _, _, n in found[1:]))
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 2048
    return len(sequences), sum(map(len, ids.values())) / 2048


def test_packing(spark):
    used, least = check_packed(queries.op5_best_fit_packing(spark, MIDDLE).collect(), texts(spark, MIDDLE))
    assert used <= 1.02 * least + 1


def test_packing_odd(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_packed(packing.pack(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), path).collect(), dict(enumerate(TEXTS)))
    assert packing.pack(odd, path).select("doc_id").distinct().count() == len(TEXTS) + 1
    assert packing.pack(odd.limit(0), path).collect() == []


@pytest.mark.parametrize(("query", "label", "folds", "out", "least"), [(queries.op6_quality, "quality", 5, 0, 0.85), (queries.op9_toxicity, "toxic", 3, 1, 0.9)])
def test_held_out_labels(spark, query, label, folds, out, least):
    rows = {r.doc_id: r for r in query(spark, MIDDLE).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % folds == out) and 0 <= r.score <= 1 for i, r in rows.items())
    known = [(rows[r.doc_id], r[label]) for r in table(spark, MIDDLE, "labels").collect()]
    right = [r.predicted == y for r, y in known if r.held_out]
    assert len(right) > 20 and np.mean(right) >= least


def test_language(spark):
    rows = queries.op7_language_id(spark, MIDDLE).collect()
    languages = {r.doc_id: r.lang for r in table(spark, MIDDLE, "documents").collect()}
    right = [r.lang_pred == languages[r.doc_id] for r in rows if r.held_out and languages[r.doc_id]]
    assert len(rows) == len(languages) and np.mean(right) >= 0.9


def test_classifiers_odd(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    for learned, score in ((quality.learn(odd, labels), quality.score_documents), (toxicity.learn(odd, labels), toxicity.score_documents), (langid.learn(odd), langid.identify)):
        for docs, n in ((odd, len(TEXTS) + 2), (odd.limit(0), 0)):
            rows = score(docs, learned).collect()
            assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r.lang_pred for r in langid.identify(odd, langid.learn(odd)).collect()}
    assert found[0] == found[1] == found[2] == "und"
    for none in (quality.learn(odd, labels.limit(0)), quality.learn(odd.limit(0), labels)):
        assert quality.score_documents(odd, none).count() == len(TEXTS) + 2


@pytest.mark.parametrize("sf_dir", [MIDDLE, "/root/testdata/sf0.1"])
def test_neighbours(spark, sf_dir):
    rows = queries.op8_nearest_neighbours(spark, sf_dir).collect()
    given = table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in given]), np.array([r.embedding for r in given], np.float64)
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        mine = found[q]
        assert len(mine) == min(20, len(ids) - 1) and mine == sorted(mine, key=lambda p: (-p[1], p[0]))
        assert np.allclose([s for _, s in mine], [score[np.searchsorted(ids, v)] for v, _ in mine], rtol=1e-12)
        hits += len({v for v, _ in mine} & set(ids[order].tolist()))
        total += len(order)
    print("recall", hits / total)
    assert hits / total >= 0.9


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 0.0]), (None, [1.0, 1.0]), (6, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [tuple(r) for r in neighbours.search(vectors).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 5, 1.0), (0, 2, 6, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 5, 0.5), (20, 3, 6, 0.5)]
    assert neighbours.search(vectors.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SMALL)) == oracle_rows(queries.oracle_sql()[name], SMALL)


def test_lines_odd(spark, odd):
    found = lines.drop_boilerplate(odd)
    assert found.count() == len(TEXTS) + 2 and lines.drop_boilerplate(odd.limit(0)).collect() == []
    rows = [(i, f"menu\nown {i}\n\n", "site") for i in range(12)] + [(100, "menu\nx", None)]
    cut = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert cut[3] == ("own 3\n\n", 4, 1) and cut[100] == ("menu\nx", 2, 0)


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        assert after.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty(), name
        docs = after
    left = texts(spark, SMALL).keys() & {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == left
