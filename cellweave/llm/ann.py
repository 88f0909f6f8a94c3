"""Approximate nearest neighbours (operator 8) by learned partitions.

On a bounded sample of the vectors an exact neighbour graph is built and split into balanced parts:
parts grow from balanced clusters, then vertices move to the part that most of their neighbours are
in, as far as part sizes allow. A small classifier (one hidden layer) learns to tell a vector's part
from the vector. It sends every row to its likeliest part and every query to its several likeliest
parts, where exact cosines rerank all rows.

Every row is indexed; only the fit is sampled. Parts grow with the table, so that the rows of a part do
not. The number of parts that a query probes is chosen on
the sample: queries held out of the fit are compared with their exact neighbours in the sample, and
parts are added until the wanted recall is passed with a margin.

A part's rows are cut into blocks by a hash of their id, as many as its size needs, and the queries
sent to the part meet each block; so neither a large part nor many copies of one vector make a large
task. Each block returns its nearest k a query, and these are merged by an aggregation.

Defined cases: vectors that are null, zero, hold null or non-finite components or differ in
dimension from the most common one take no part; ties go to the smaller id; rows without id take no
part; a repeated id counts as separate rows, and a query skips every row of its own id; fewer
candidates than k give fewer neighbours; extra columns play no part; empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, stored

#: Parts: one for so many rows, within bounds.
ROWS_A_PART, LEAST_PARTS, MOST_PARTS = 50_000, 24, 1024
#: Bound of the sample that parts and classifier are learned from, in vectors; more parts take SAMPLE_A_PART each.
SAMPLE, SAMPLE_A_PART = 6000, 64
NEIGHBOURS = 10
#: Rows a block holds about.
BLOCK = 25_000
QUERY_BLOCK = 512


class Router:
    """A network with one hidden layer; its outputs order the parts for a vector."""

    def __init__(self, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray, probes: int):
        self.w1, self.b1, self.w2, self.b2, self.probes = w1, b1, w2, b2, probes

    def logits(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, unit: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(unit), axis=1, kind="stable")[:, :n]


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows over their length; a first division by the largest entry keeps squares finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(unit), min(k, len(unit) - 1)), dtype=np.int32)
    for at in range(0, len(unit), 512):
        near = unit[at : at + 512] @ unit.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -2
        out[at : at + 512] = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """A part for each vertex, sizes at most 1.15 of the mean, few neighbours in other parts."""
    n, limit = len(unit), int(math.ceil(len(unit) / parts * 1.15))
    centres = unit[rng.choice(n, parts, replace=False)]
    for _ in range(12):
        part = assigned(unit @ centres.T, limit)
        centres = np.stack([unit[part == p].mean(axis=0) if (part == p).any() else unit[rng.integers(n)] for p in range(parts)])
        centres /= np.maximum(np.sqrt((centres**2).sum(axis=1, keepdims=True)), 1e-12)
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        part = assigned(votes + 0.5 * (unit @ centres.T), limit)
    return part


def assigned(worth: np.ndarray, limit: int) -> np.ndarray:
    """Each row to its worthiest column with room; rows that would lose most go first."""
    order = np.argsort(-worth, axis=1, kind="stable")
    top = np.take_along_axis(worth, order[:, :2], axis=1)
    part, room = np.empty(len(worth), dtype=np.int32), [limit] * worth.shape[1]
    for i in np.argsort(-(top[:, 0] - top[:, -1]), kind="stable").tolist():
        for p in order[i].tolist():
            if room[p]:
                part[i], room[p] = p, room[p] - 1
                break
    return part


def fit_router(unit: np.ndarray, part: np.ndarray, parts: int, graph: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 60) -> Router:
    """Softmax regression with a hidden layer; targets are the parts of a vector and its neighbours."""
    n, d = unit.shape
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    target[np.arange(n), part] += 0.5
    shape = [rng.normal(0, math.sqrt(2 / d), (d, hidden)) * math.sqrt(d) / 2, np.zeros(hidden), rng.normal(0, math.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in shape]
    t = 0
    for epoch in range(epochs):
        rate = 0.003 * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(n), max(1, n // 256)):
            t += 1
            x = unit[rows]
            h = np.maximum(x @ shape[0] + shape[1], 0)
            z = h @ shape[2] + shape[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            gap = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = (gap @ shape[2].T) * (h > 0)
            for w, (m, v), g in zip(shape, moments, (x.T @ back, back.sum(axis=0), h.T @ gap, gap.sum(axis=0)), strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Router(*shape, probes=parts)


def learn(sample: np.ndarray, parts: int = LEAST_PARTS, k: int = 5, recall: float = 0.95, seed: int = 7) -> Router:
    """Fits parts and router, and sets how many parts a query probes."""
    rng = np.random.default_rng(seed)
    unit = unit_rows(sample)[rng.permutation(len(sample))]
    held = unit[: max(1, len(unit) // 6)]
    base = unit[len(held) :] if len(unit) > len(held) + 1 else unit
    parts = max(1, min(parts, len(base) // 16))
    if parts == 1 or len(base) < 3:
        return Router(np.zeros((unit.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(base, NEIGHBOURS)
    router = fit_router(base, balanced_parts(base, graph, parts, rng), parts, graph, rng)
    home = router.ranked(base, 1)[:, 0]
    ranks = np.argsort(np.argsort(-router.logits(held), axis=1, kind="stable"), axis=1)
    near = np.argsort(-(held @ base.T), axis=1, kind="stable")[:, :k]
    needed = np.take_along_axis(ranks, home[near], axis=1)  # place of each true neighbour's part in the query's order
    found = [(needed < probes).mean() for probes in range(1, parts + 1)]
    router.probes = next((p for p, f in enumerate(found, 1) if f >= recall), parts)
    return router


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~F.coalesce(bad, F.lit(False)) & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each from its two vectors alone (no dependence on the block)."""
    dot = (rows * query).sum(axis=1)
    return dot / (np.sqrt((rows * rows).sum(axis=1)) * math.sqrt(float((query * query).sum())))


def search(table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", rows_a_part: int = ROWS_A_PART, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): nearest rows of the rows whose id is divisible by ``every``."""
    spark = table.sparkSession
    rows = vectors(table, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("v") == sizes["d"])
    bounded_batches(spark)
    parts = min(MOST_PARTS, max(LEAST_PARTS, -(-sizes["n"] // rows_a_part)))
    # distinct vectors, so that copies do not fill the sample
    sample = rows.select("v", F.xxhash64("v").alias("h")).groupBy("h").agg(F.first("v").alias("v")).orderBy(F.xxhash64("h")).limit(max(SAMPLE, SAMPLE_A_PART * parts))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [matrix(b.column("v")) for b in batches if b.num_rows]
        if found:
            data = np.concatenate(found)
            r = learn(data[np.lexsort(data.T)], parts, k, recall)
            blobs = [np.ascontiguousarray(x).tobytes() for x in (r.w1, r.b1, r.w2, r.b2)]
            yield pa.RecordBatch.from_arrays([pa.array([blobs], pa.list_(pa.binary())), pa.array([len(r.b1)], pa.int32()), pa.array([len(r.b2)], pa.int32()), pa.array([r.probes], pa.int32())], ["w", "hidden", "parts", "probes"])

    got = sample.repartition(1).mapInArrow(fitted, "w array<binary>, hidden int, parts int, probes int").first()
    w = [np.frombuffer(bytes(x)) for x in got.w]
    router = Router(w[0].reshape(-1, got.hidden), w[1], w[2].reshape(got.hidden, -1), w[3], got.probes)
    held = spark.sparkContext.broadcast(router)  # a few hundred KB, whatever the input

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            order = r.ranked(unit_rows(matrix(batch.column("v"))), r.probes)
            probes = [o if q else o[:1] for o, q in zip(order.tolist(), (np.mod(batch.column("vec_id").to_numpy(), every) == 0).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probes, pa.list_(pa.int32()))], [*batch.schema.names, "probes"])

    placed = stored(rows.mapInArrow(routed, "vec_id long, v array<double>, probes array<int>"), "ann-rows")
    home = placed.select(F.col("probes")[0].alias("part"), "vec_id", "v")
    counts = {r["part"]: r["n"] for r in home.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_PARTS rows
    blocks = {p: max(1, -(-n // BLOCK)) for p, n in counts.items()}
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for p, n in sorted(blocks.items()) for x in (p, n)]), F.col("part"))
    asked = placed.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.explode("probes").alias("part")).where(F.col("part").isin(list(blocks)))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    given = home.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), n_blocks).cast("int"))
    both = given.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    wanted = k

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by part, block and asks: a block's rows come first, then its queries in small lots."""
        now, ids, data, done = None, [], [], None
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            if batch.num_rows:
                key = batch.column("part").to_numpy().astype(np.int64) << 32 | batch.column("block").to_numpy()
                asks, v = batch.column("asks").to_numpy(zero_copy_only=False), matrix(batch.column("v"))
                vec = batch.column("vec_id").to_numpy()
                cuts = np.flatnonzero((np.diff(key) != 0) | (asks[1:] != asks[:-1])) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                    if key[lo] != now:
                        now, ids, data, done = key[lo], [], [], None
                    if not asks[lo]:
                        ids.append(vec[lo:hi])
                        data.append(v[lo:hi])
                    elif ids:
                        if done is None:
                            done = (np.concatenate(ids), np.concatenate(data))
                            done = (*done, unit_rows(done[1]))
                        out += best(done, vec[lo:hi], v[lo:hi])
            types = [pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, types, strict=True)], ["query_id", "vec_id", "score"])

    def best(block: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, int, float]]:
        ids, data, unit = block
        for at in range(0, len(queries), QUERY_BLOCK):
            near = unit_rows(v[at : at + QUERY_BLOCK]) @ unit.T
            for i, row in enumerate(near):
                q = queries[at + i]
                row[ids == q] = -2
                # all rows within rounding of the k-th are scored exactly
                floor = np.partition(row, -wanted)[-wanted] - 1e-9 if len(row) > wanted else -1.5
                some = np.flatnonzero((row >= floor) & (row > -1.5))
                scores = cosines(v[at + i], data[some])
                yield from ((int(q), b, -a) for a, b in heapq.nsmallest(wanted, zip((-scores).tolist(), ids[some].tolist(), strict=True)))

    dealt = both.repartition(partitions(spark), "part", "block").sortWithinPartitions("part", "block", "asks", "vec_id")
    found = dealt.select("part", "block", "asks", "vec_id", "v").mapInArrow(nearest, "query_id long, vec_id long, score double")
    # at most k rows of each probed block a query
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))


def exact(table: DataFrame, k: int = 5, every: int = 50) -> dict[int, list[tuple[int, float]]]:
    """Brute force on the driver, for measuring recall on test data only."""
    got = sorted((r.vec_id, r.v) for r in vectors(table, "vec_id", "embedding").collect())
    ids, data = np.array([i for i, _ in got]), np.array([v for _, v in got])
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = cosines(data[i], data)
        order = [j for j in np.lexsort((ids, -scores)).tolist() if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out
