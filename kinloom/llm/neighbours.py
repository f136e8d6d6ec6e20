"""Approximate nearest neighbours by inner product with learned partitions.

On a bounded sample the graph of nearest neighbours is cut into partitions of equal size with few cut edges, and a small
network learns, for each vector, in which partitions its neighbours lie. Every row is indexed in its most probable
partition; a query goes to its most probable partitions until their probabilities add up to `mass`, which is the least
that finds `TARGET` of the neighbours on the sample; what it meets there is ranked exactly.

Partitions are dealt in blocks of bounded numbers of rows and of queries, so a partition that holds a third of all rows is
many tasks. Each block returns at most `k` rows for a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, written
from .ragged import runs

SAMPLE_ROWS = 8_000
PARTITION_ROWS = 300
LEAST_SAMPLED = 48
GRAPH = 10
HIDDEN = 96
TARGET = 0.95
BLOCK_ROWS, BLOCK_QUERIES, RANKED_QUERIES = 8_192, 4_096, 256


def nearest(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Indices of the `k` rows of `x` with the largest inner product for each query (an index into `x`), without itself."""
    out = []
    for at in range(0, len(queries), 128):
        rows = queries[at : at + 128]
        score = x[rows] @ x.T
        score[np.arange(len(rows)), rows] = -np.inf
        np.negative(score, out=score)
        out.append(np.argpartition(score, min(k, score.shape[1] - 1) - 1, axis=1)[:, :k].astype(np.int32))
    return np.concatenate(out) if out else np.empty((0, k), np.int64)


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """The part of each node: halves along the direction of largest spread, then moves to the part where most of a node's
    neighbours are while that part has room."""
    part = np.zeros(len(x), np.int64)
    done = 1
    while done < parts:
        for p in range(done):
            rows = np.flatnonzero(part == p)
            y = x[rows] - x[rows].mean(axis=0)
            line = np.ones(x.shape[1]) + np.arange(x.shape[1]) / x.shape[1]
            for _ in range(8):
                line = y.T @ (y @ line)
                line /= np.linalg.norm(line) + 1e-12
            part[rows[np.argsort(y @ line, kind="stable")[len(rows) // 2 :]]] += done
        done *= 2
    most = int(np.ceil(1.05 * len(x) / parts))
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.arange(len(x))[:, None], part[graph]), 1)
        np.add.at(votes, (graph, np.broadcast_to(part[:, None], graph.shape)), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            if size[best[i]] < most:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i], moved = best[i], moved + 1
        if not moved:
            break
    return part


@dataclass
class Model:
    weights: list[np.ndarray]
    mass: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _probabilities(x, self.weights)[0]


def _probabilities(x: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = weights
    hidden = np.maximum(x @ w1 + b1, 0)
    logit = hidden @ w2 + b2
    e = np.exp(logit - logit.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True), hidden


def _train(x: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 3e-3) -> list[np.ndarray]:
    maker = np.random.default_rng(11)
    scale = 1 / (np.abs(x).mean() + 1e-12)
    weights = [maker.normal(0, scale / x.shape[1] ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), maker.normal(0, HIDDEN**-0.5, (HIDDEN, target.shape[1])), np.zeros(target.shape[1])]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    rates = [rate * scale, rate, rate, rate]
    for _ in range(epochs):
        order = maker.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            p, hidden = _probabilities(x[rows], weights)
            error = (p - target[rows]) / len(rows)
            back = error @ weights[2].T * (hidden > 0)
            step += 1
            for k, g in enumerate([x[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - rates[k] * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-10)
    return weights


def fit(x: np.ndarray, parts: int, k: int) -> Model:
    """The model for a sample of vectors; with one part everything goes to it."""
    if parts < 2 or len(x) < 4 * parts:
        return Model([np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1.0)
    graph = nearest(x, np.arange(len(x)), GRAPH)
    part = balanced_partition(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x))[:, None], part[graph]), 1 / graph.shape[1])
    # weights come from all but each fifth row, which then tell how much probability finds enough neighbours
    apart = np.arange(len(x)) % 5 == 4
    weights = _train(x[~apart], target[~apart])
    p = _probabilities(x, weights)[0]
    own, queries = p.argmax(axis=1), np.flatnonzero(apart)
    truth = nearest(x, queries, k)
    order = np.argsort(-p[queries], axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(p[queries], order, axis=1), axis=1)
    rank = np.argsort(order, axis=1, kind="stable")
    # a neighbour is found if the probability before its partition is below `mass`
    place = np.take_along_axis(rank, own[truth], axis=1)
    needed = np.where(place > 0, np.take_along_axis(sums, np.maximum(place - 1, 0), axis=1), 0.0)
    mass = float(np.quantile(needed, TARGET)) + 1e-9
    return Model(weights, min(1.0, mass))


def clean(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id long, embedding array<double>): usable vectors, one for each id (the least, if an id has several)."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _mixed(ids: np.ndarray, salt: int) -> np.ndarray:
    """A non-negative hash of each id."""
    x = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return (x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64)


def layout(held: list[int], asks: list[int], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block of each partition, its number of blocks, the number of portions of queries of each block).

    `held` and `asks` are the rows and the queries of each partition, `most` is the number of all queries. Neighbouring partitions share a block while they fit.
    """
    first, slices, asked, room = [], [], [], 0
    for rows, queries in zip(held, asks, strict=True):
        several = max(1, -(-rows // BLOCK_ROWS))
        if several > 1 or rows > room:
            asked += [0] * several
            room = BLOCK_ROWS if several == 1 else 0
        first.append(len(asked) - several)
        slices.append(several)
        room = max(0, room - rows)
        for block in range(len(asked) - several, len(asked)):
            asked[block] += queries
    return np.array(first, np.int64), np.array(slices, np.int64), np.array([max(1, -(-min(n, most) // BLOCK_QUERIES)) for n in asked], np.int64)


def _best(q: np.ndarray, q_id: np.ndarray, probed: np.ndarray, c: np.ndarray, c_id: np.ndarray, bounds: list[tuple[int, int, int]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many each query has, ids, scores): the `k` best of the rows `c` in the partitions that a query probes.

    `bounds` are (partition, first row, end) of the rows; within a partition ids ascend.
    """
    score = np.full((len(q), len(c)), -np.inf)
    for part, a, b in bounds:
        if len(rows := np.flatnonzero(probed[:, part])):
            score[rows, a:b] = q[rows] @ c[a:b].T
            own = a + np.minimum(np.searchsorted(c_id[a:b], q_id[rows]), b - a - 1)
            same = c_id[own] == q_id[rows]
            score[rows[same], own[same]] = -np.inf
    near = score > -np.inf
    if len(c) > k:
        # sums in another order differ by less than this, so nothing that may tie is lost
        slack = 1e-12 * np.sqrt((c * c).sum(axis=1).max()) * np.sqrt((q * q).sum(axis=1)) + 1e-300
        near &= score >= (np.partition(score, len(c) - k, axis=1)[:, len(c) - k] - slack)[:, None]
    row, at = np.nonzero(near)
    exact = (c[at] * q[row]).sum(axis=1)
    order = np.lexsort((c_id[at], -exact, row))
    row, at, exact = row[order], at[order], exact[order]
    size = np.bincount(row, minlength=len(q))
    kept = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) < k
    return np.minimum(size, k), c_id[at[kept]], exact[kept]


def search(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20, every: int = 20, sample_rows: int = SAMPLE_ROWS, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """(query_id, rank int, vec_id, score): for each row whose id is divisible by `every`, its `k` nearest other rows found.

    The nearest come first, ties by the smaller vec_id; all rows if there are fewer. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do null ids and vectors whose length is not the table's most frequent one (the shorter on a tie);
    an id that comes more than once counts once, with its least vector; an empty table gives no rows; other columns are
    ignored. Equal vectors tie. The sample has about `sample_rows` rows; all rows are indexed.

    Where vectors have no structure (as in a ball, in many dimensions), no partition tells where neighbours are, and finding nine of ten means
    to look at a fixed share of all rows for each query, so the work then grows with queries times rows; blocks keep every task bounded.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = written(clean(vectors, id_column, vector_column), "vectors")
    lengths = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    size, total = lengths[0]
    rows = rows.where(F.size("embedding") == size)
    share = min(1.0, sample_rows / total)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy("vec_id").select("embedding").toArrow()
    x = _matrix(sample.column(0).combine_chunks(), size) if len(sample) else np.zeros((0, size))
    parts = 1
    while parts * 2 <= min(total / partition_rows, len(x) / LEAST_SAMPLED):
        parts *= 2
    shared = spark.sparkContext.broadcast(fit(x, parts, k))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            p = model.probabilities(_matrix(batch.column(1), size))
            order = np.argsort(-p, axis=1, kind="stable")
            before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
            asks = np.maximum(1, (before < model.mass).sum(axis=1))
            ids = batch.column(0).to_numpy()
            probes = [order[i, : asks[i]].tolist() if ids[i] % every == 0 else [] for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order[:, 0].astype(np.int32)), pa.array(probes, pa.list_(pa.int32()))], names=["vec_id", "embedding", "part", "probes"])

    routed = written(arrow_map(rows.select("vec_id", "embedding"), route, "vec_id long, embedding array<double>, part int, probes array<int>"), "routed")
    asked = routed.where(F.size("probes") > 0).select("vec_id", "embedding", "probes")
    held = {r[0]: r[1] for r in routed.groupBy("part").count().collect()}  # one row for each partition
    asks = {r[0]: r[1] for r in asked.select(F.explode("probes").alias("part")).groupBy("part").count().collect()}
    laid = spark.sparkContext.broadcast(layout([held.get(p, 0) for p in range(parts)], [asks.get(p, 0) for p in range(parts)], asked.count()))

    def deal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, slices, portions = laid.value
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False)
            block = first[part] + _mixed(batch.column("vec_id").to_numpy(zero_copy_only=False), 1) % slices[part]
            row = np.repeat(np.arange(len(part)), portions[block])
            portion = np.arange(len(row)) - np.repeat(np.cumsum(portions[block]) - portions[block], portions[block])
            kept = [batch.column(name).take(pa.array(row)) for name in ("vec_id", "embedding", "part")]
            yield pa.RecordBatch.from_arrays([pa.array(block[row]), pa.array(portion), *kept], names=["block", "portion", "vec_id", "embedding", "part"])

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, slices, portions = laid.value
        for batch in batches:
            probes = batch.column("probes")
            part = probes.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(probes.offsets.to_numpy()))
            pairs = np.unique(np.stack((np.repeat(owner, slices[part]), runs(first[part], slices[part])), axis=1), axis=0)
            row, block = pairs[:, 0], pairs[:, 1]
            portion = _mixed(batch.column("vec_id").to_numpy(zero_copy_only=False), 2)[row] % portions[block]
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(portion), *(c.take(pa.array(row)) for c in batch.columns)], names=["block", "portion", *batch.schema.names])

    def rank(query_table: pa.Table, candidate_table: pa.Table) -> pa.Table:
        ids, scores, sizes = [np.empty(0, np.int64)], [np.empty(0)], []
        asking = query_table.column("vec_id").to_numpy()
        if query_table.num_rows and candidate_table.num_rows:
            q, c = (_matrix(t.column("embedding").combine_chunks(), size) for t in (query_table, candidate_table))
            lists = query_table.column("probes").combine_chunks()
            probed = np.zeros((len(q), parts), bool)
            probed[np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)] = True
            c_id, part = candidate_table.column("vec_id").to_numpy(), candidate_table.column("part").to_numpy()
            order = np.lexsort((c_id, part))
            c, c_id, part = c[order], c_id[order], part[order]
            edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            for at in range(0, len(q), RANKED_QUERIES):
                some = slice(at, at + RANKED_QUERIES)
                found = _best(q[some], asking[some], probed[some], c, c_id, [(int(part[a]), a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], k)
                sizes.append(found[0])
                ids.append(found[1])
                scores.append(found[2])
        else:
            asking = asking[:0]
        offsets = pa.array(np.concatenate(([0], *map(np.atleast_1d, sizes))).cumsum().astype(np.int32))
        return pa.table({"query_id": asking, "ids": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))), "scores": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(scores)))})

    keys = ("block", "portion")
    candidates = arrow_map(routed.select("vec_id", "embedding", "part"), deal_rows, "block long, portion long, vec_id long, embedding array<double>, part int")
    queries = arrow_map(asked, deal_queries, "block long, portion long, vec_id long, embedding array<double>, probes array<int>")
    met = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(rank, "query_id long, ids array<long>, scores array<double>")
    found = met.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("query_id", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
