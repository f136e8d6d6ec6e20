"""SimHash near-duplicates: segment-popcount embedding, grid range join under Manhattan distance, exact verification.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints, so texts within `BITS` = 4 bits have embeddings within 4, and
one half of the embedding (16 segments) within 2. On each half every fingerprint goes to its own grid point and to the points
one step away; two points within distance 2 always share such a point, so no link is lost. What meets at a point is
then verified exactly by the bits that differ. Only distinct fingerprints take part: exact copies cost one grid entry.

At each point a spanning forest of the verified links is kept, never all pairs. A point with more than `POINT_ROWS`
fingerprints is set aside and dealt in pairs of blocks, which gives the same links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, written
from .components import components

SEED = 42
BITS = 4
WORDS = 4
HALF = 16
POINTS = 3**HALF
POINT_ROWS = 20_000
CHUNK = 1 << 20
SLICES = 16


def _word_runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, in runs of about a megabyte."""
    data = text.encode()
    at, size = 0, len(data)
    while at < size:
        end = min(size, at + CHUNK)
        while end < size and data[end] not in b" \t\n\v\f\r":
            end = min(size, end + 4096)
            if end < size:  # a word that spans the cut: go on to its end
                ends = [x for x in (data.find(c, end - 4096, end) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if x >= 0]
                if ends:
                    end = min(ends)
                    break
        yield data[at:end].lower().split()
        at = end


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text's shingles; 0 for null or a text without words."""
    counts, total, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def add(hashes: list[int]) -> None:
        nonlocal counts, total
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)

    for run in _word_runs(text or ""):
        words = tail + run
        tail = words[-(WORDS - 1) :]
        if (n := len(words)) < WORDS:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - WORDS] + 1))
        add([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[WORDS - 1 :].tolist(), strict=True)])
    if not total and tail:
        add([digest(b" ".join(tail), SEED)])
    return int((2 * counts > total).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id long, fp long): the fingerprint's bits as a signed long, one row for each row of `docs`; if `hashed`, with
    the text's hash (long) as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    text = F.col(text_column).cast("string")
    more = [F.xxhash64(text).alias("hash")] if hashed else []
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), *more)
    return arrow_map(rows, run, "doc_id long, fp long" + ", hash long" * hashed)


def grid_points(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, index of the fingerprint) for the own point and those one step away, on both halves."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    counts = bits[:, 0::2] + bits[:, 1::2]
    weights = 3 ** np.arange(HALF, dtype=np.int64)
    points, owners, index = [], [], np.arange(len(fps))
    for half in (0, 1):
        part = counts[:, half * HALF : (half + 1) * HALF]
        own = part @ weights + half * POINTS
        points.append(own)
        owners.append(index)
        for k in range(HALF):
            for step, free in ((1, part[:, k] < 2), (-1, part[:, k] > 0)):
                points.append(own[free] + step * weights[k])
                owners.append(index[free])
    return np.concatenate(points), np.concatenate(owners)


def forest(fps: np.ndarray, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within `fps`, or of those between `fps` and `others`."""
    left, right = [], []
    if others is None:
        rest = fps
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                node = queue.pop()
                near = np.bitwise_count(rest ^ node) <= BITS
                if near.any():
                    found, rest = rest[near], rest[~near]
                    left.append(np.full(len(found), node))
                    right.append(found)
                    queue.extend(found)
    else:
        sides = [fps, others]
        while len(sides[0]) and len(sides[1]):
            queue, sides[0] = [(0, sides[0][0])], sides[0][1:]
            while queue:
                side, node = queue.pop()
                rest = sides[1 - side]
                near = np.bitwise_count(rest ^ node) <= BITS
                if near.any():
                    found, sides[1 - side] = rest[near], rest[~near]
                    left.append(np.full(len(found), node))
                    right.append(found)
                    queue.extend((1 - side, x) for x in found)
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def _links(distinct: DataFrame, point_rows: int) -> DataFrame:
    """(u, v): links whose components are those of all links; `distinct` has one row for each fingerprint."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                fps = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
                points, owners = grid_points(fps)
                yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(fps[owners].view(np.int64))], names=["point", "fp"])

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by point. kind 0: a link; kind 1: a point that is set aside, and one of its fingerprints."""
        held_point, held, aside = None, np.empty(0, np.uint64), False

        def close() -> Iterator[pa.RecordBatch]:
            if not aside and len(held) > 1:
                a, b = forest(held)
                if len(a):
                    yield out(0, a, b)

        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero(points[1:] != points[:-1]) + 1
            starts = np.concatenate(([0], cuts))
            ends = np.concatenate((cuts, [len(points)]))
            # the first and the last group may go on in other batches; those between them are whole
            inner = slice(1, len(starts) - 1)
            sizes = (ends - starts)[inner]
            rows = np.flatnonzero(sizes == 2) + 1
            a, b = fps[starts[rows]], fps[starts[rows] + 1]
            near = np.bitwise_count(a ^ b) <= BITS
            if near.any():
                yield out(0, a[near], b[near])
            groups = [0, *(np.flatnonzero(sizes > 2) + 1).tolist(), *([len(starts) - 1] if len(starts) > 1 else [])]
            for g in groups if len(points) else []:
                point, mine = int(points[starts[g]]), fps[starts[g] : ends[g]]
                if point != held_point:
                    yield from close()
                    held_point, held, aside = point, mine, False
                elif not aside:
                    held = np.concatenate((held, mine))
                if not aside and len(held) > point_rows:
                    aside, mine = True, held
                if aside:
                    yield out(1, np.full(len(mine), point).view(np.uint64), mine)
                    held = held[:0]
        yield from close()

    points = arrow_map(distinct.select("fp"), spread, "point long, fp long")
    sorted_points = points.repartition("point").sortWithinPartitions("point")
    found = written(arrow_map(sorted_points, meet, "kind int, a long, b long"), "links")
    links = found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    aside = found.where("kind = 1").select(F.col("a").alias("point"), F.col("b").alias("fp"))
    if aside.isEmpty():
        return links
    return links.unionByName(_by_blocks(aside, point_rows))


def _by_blocks(aside: DataFrame, point_rows: int) -> DataFrame:
    """The links at points with very many fingerprints: each pair of a point's blocks is one group of bounded size."""
    block = max(1, point_rows // 2)
    blocks = aside.groupBy("point").agg(F.ceil(F.count("*") / block).alias("n"))
    rows = aside.join(blocks, "point").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    rows = rows.withColumn("other", other).select("point", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"), "fp")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        second = group.column("second").to_numpy(zero_copy_only=False)
        a, b = forest(fps) if key[1].as_py() == key[2].as_py() else forest(fps[~second], fps[second])
        return pa.table({"u": pa.array(a.view(np.int64)), "v": pa.array(b.view(np.int64))})

    return rows.groupBy("point", "i", "j").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", point_rows: int = POINT_ROWS) -> DataFrame:
    """(doc_id long, fingerprint string, component_id long), one row for each row of `docs`.

    Fingerprints link at `BITS` or fewer differing bits; component_id is the smallest id reachable, the own one included.
    Null and wordless texts have fingerprint zero and link like any other; shorter texts than a shingle are hashed whole;
    rows with a null id get the smallest id of their component, and null only if it has none; repeated rows repeat;
    an empty table gives no rows; other columns are ignored.
    """
    found = _grouped(fingerprints(docs, id_column, text_column), point_rows)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(fps: DataFrame, point_rows: int) -> DataFrame:
    """The rows of `fps` with root (a fingerprint that names the component) and component_id."""
    fps = written(fps, "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(_links(distinct, point_rows), "u", "v")
    placed = written(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "root"), "placed")
    alone = placed.where("root IS NULL").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    # a component may be very large, so its name is joined back in slices
    linked = placed.where("root IS NOT NULL").withColumn("slice", F.pmod(F.xxhash64("fp"), F.lit(SLICES)))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))))
    return fps.join(alone.unionByName(linked.join(least, ["root", "slice"]).select("fp", "root", "component_id")), "fp")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", point_rows: int = POINT_ROWS) -> DataFrame:
    """The rows of `docs`, of each group of near-duplicates only the one with the smallest id, with all its columns.

    Of rows of a group that repeat that id the one whose text has the least hash stays, and of equal texts the one whose
    columns have. Rows with one id in several groups stand for themselves in each. Rows with a null id can be told from
    no other row and stay.
    """
    found = _grouped(fingerprints(docs.where(F.col(id_column).isNotNull()), id_column, text_column, True), point_rows)
    kept = found.where("doc_id = component_id").groupBy("root").agg(F.min("doc_id").alias("__kept"), F.min("hash").alias("__hash"))
    kept = written(kept.select("__kept", "__hash"), "kept")
    order = Window.partitionBy("__kept", "__hash").orderBy(F.xxhash64(*(name for name, kind in docs.dtypes if "map<" not in kind)))
    same = (F.col(id_column).cast("long") == F.col("__kept")) & (F.xxhash64(F.col(text_column).cast("string")) == F.col("__hash"))
    rows = docs.join(kept, same).withColumn("__row", F.row_number().over(order))
    return rows.where("__row = 1").select(docs.columns).unionByName(docs.where(F.col(id_column).isNull()))
