"""Toxicity (operator 1): character n-gram linear classifier with naive Bayes log-count ratios.

Features are hashed character n-grams (code points, A-Z lower-cased) that a text contains or not.
From a bounded sample of labelled documents each feature gets its naive Bayes log-count ratio

    r = log((df_toxic + 1) / (n_toxic + 1)) - log((df_clean + 1) / (n_clean + 1))

A feature's present value is r; logistic regression with an L2 penalty is fitted on these values for
the features whose ratio stands out most from chance (r over its standard error) with a support that
a few copied documents cannot give. The intercept is moved from the sample's class balance to that
of all learning labels. The score is the logistic of the intercept and the weights of the features
that the whole text contains: one map over the documents with a broadcast table of fixed size.

The sample: at most ``max_rows`` learning rows a class, chosen by a hash of the id; of documents that
share their least 8-gram hash (copies) one counts. Rows with crc32(doc_id as text) mod 5 = 0 never
take part. Without both classes the score is the share of toxic labels, or 0.5 without labels.

Defined cases: null text counts as empty and scores the intercept; documents without label are
scored like others; a null id is held out by the checksum of the empty text; repeated rows score
alike; extra columns play no part, and one with the name of the output column gives way to it; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Masked, bounded_batches, raw_texts

BITS = 20
SIZES = (4, 5)
#: Bound of the learning sample, rows a class.
MAX_ROWS = 2000
#: Features that the regression sees.
MAX_FEATURES = 4096
#: Present features that a step of the regression looks at together.
FIT_BLOCK = 1 << 18
#: Code points that are hashed together.
PIECE = 1 << 19
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], dtype=np.uint32)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def points(raw: bytes) -> np.ndarray:
    """Code points of a UTF-8 text, A-Z lower-cased."""
    return np.frombuffer(raw.lower().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")


def grams(buf: np.ndarray, size: int) -> np.ndarray:
    """Hashed n-grams at every position of a buffer of code points; sizes share the space but not the hashes."""
    n = len(buf) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32)
    out = np.full(n, size * 0x9E37, dtype=np.uint32)
    for i in range(size):
        out += (buf[i : i + n] + np.uint32(1)) * _MULTIPLIERS[i]
        out ^= out >> np.uint32(15)
        out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out


def features(raw: bytes, bits: int = BITS) -> np.ndarray:
    """Sorted distinct features of a whole text, in pieces that overlap by an n-gram."""
    buf, step, parts = points(raw), PIECE, []
    for size in SIZES:
        for at in range(0, max(1, len(buf) - size + 1), step):
            parts.append(np.unique(grams(buf[at : at + step + size - 1], size) >> np.uint32(32 - bits)))
    return np.unique(np.concatenate(parts))


@dataclass
class Model:
    """weights: one float a feature (0 for those not chosen); bounded by 2^bits values."""

    bias: float
    weights: np.ndarray

    def score(self, raw: bytes) -> float:
        return self.scores([raw])[0]

    def scores(self, texts: list[bytes]) -> list[float]:
        """Texts are looked at together, in blocks; only chosen features are told apart by text."""
        sums = np.full(len(texts), self.bias)
        block, size, begin = [], 0, 0
        for i, raw in enumerate(texts):
            block.append(points(raw))
            size += len(block[-1])
            if size >= PIECE or i == len(texts) - 1:
                sums[begin : i + 1] += self._block(block)
                block, size, begin = [], 0, i + 1
        return (1 / (1 + np.exp(-np.clip(sums, -500, 500)))).tolist()

    def _block(self, texts: list[np.ndarray]) -> np.ndarray:
        joined = np.concatenate(texts)
        ends = np.cumsum([len(t) for t in texts])
        seen, step = [], PIECE
        for size in SIZES:
            for at in range(0, len(joined), step):
                ids = grams(joined[at : at + step + size - 1], size) >> np.uint32(32 - BITS)
                hit = np.flatnonzero(self.weights[ids])
                place = hit + at
                owner = np.searchsorted(ends, place, side="right")
                inside = place + size <= ends[owner]  # not across the end of a text
                seen.append((owner[inside].astype(np.int64) << BITS) | ids[hit[inside]])
        pairs = np.unique(np.concatenate(seen)) if seen else np.empty(0, dtype=np.int64)
        return np.bincount(pairs >> BITS, weights=self.weights[pairs & ((1 << BITS) - 1)], minlength=len(texts))


def _blocks(rows: list[tuple[int, np.ndarray]], place: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, index, owner) of runs of rows: the chosen features present and their row in the run."""
    held, size, first = [], 0, 0
    for i, (_, ids) in enumerate(rows):
        own = place[ids]
        held.append(own[own >= 0])
        size += len(held[-1])
        if size >= FIT_BLOCK or i == len(rows) - 1:
            yield first, i + 1, np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.int32), [len(k) for k in held])
            held, size, first = [], 0, i + 1


def fit(rows: list[tuple[int, np.ndarray]], prior: float, max_features: int = MAX_FEATURES, penalty: float = 1.0, steps: int = 300) -> Model:
    """Logistic regression on ratio-scaled features; rows: (label, sorted features)."""
    weights = np.zeros(1 << BITS, dtype=np.float32)
    label = np.array([y for y, _ in rows], dtype=np.float64)
    n1, n0 = int(label.sum()), int(len(label) - label.sum())
    if not n1 or not n0:
        return Model(float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))), weights)
    df1, df0 = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
    for y, ids in rows:
        (df1 if y else df0)[ids] += 1
    p, q = df1 + 1.0, df0 + 1.0
    ratio = np.log(p / (n1 + 1)) - np.log(q / (n0 + 1))
    spread = np.sqrt(1 / p + 1 / q)
    support = np.maximum(df1 / n1, df0 / n0) >= max(0.02, 3 / min(n1, n0))
    strength = np.where(support, np.abs(ratio) / spread, 0)
    chosen = np.argsort(-strength, kind="stable")[:max_features]
    chosen = np.sort(chosen[strength[chosen] > 3.0])
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    scale, blocks = ratio[chosen], list(_blocks(rows, place))
    w, b = np.zeros(len(chosen)), float(np.log(n1 / n0))
    mean_w, var_w, mean_b, var_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam over the whole sample
        z, value, raw = np.full(len(rows), b), w * scale, np.zeros(len(chosen))
        for first, last, index, owner in blocks:
            z[first:last] += np.bincount(owner, weights=value[index], minlength=last - first)
        gap = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label) / len(rows)
        for first, last, index, owner in blocks:
            raw += np.bincount(index, weights=gap[first:last][owner], minlength=len(chosen))
        gw = raw * scale + penalty * w / len(rows)
        gb = gap.sum()
        mean_w, var_w = 0.9 * mean_w + 0.1 * gw, 0.99 * var_w + 0.01 * gw * gw
        mean_b, var_b = 0.9 * mean_b + 0.1 * gb, 0.99 * var_b + 0.01 * gb * gb
        w -= 0.02 * (mean_w / (1 - 0.9**t)) / (np.sqrt(var_w / (1 - 0.99**t)) + 1e-8)
        b -= 0.02 * (mean_b / (1 - 0.9**t)) / (np.sqrt(var_b / (1 - 0.99**t)) + 1e-8)
    weights[chosen] = w * scale
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    return Model(b + float(np.log(prior / (1 - prior)) - np.log(n1 / n0)), weights)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits on the learning rows; the sample's features meet in one task of bounded size."""
    spark = docs.sparkSession
    rows = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("__y"))
    rows = rows.groupBy("doc_id").agg(F.max("__y").alias("__y"))
    counts = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    order = [F.md5(F.concat(F.lit("toxicity"), F.col("doc_id").cast("string"))), F.col("doc_id")]
    sample = rows.where("__y = 1").orderBy(*order).limit(max_rows).unionByName(rows.where("__y = 0").orderBy(*order).limit(max_rows))
    taken = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 2 * max_rows ids

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, least = [], []
            for raw in raw_texts(batch):
                own = features(raw)
                ids.append(own.astype("<u4").tobytes())
                # copies share their least hash of 8-grams with high probability
                whole = grams(points(raw), 8)
                least.append(int(whole.min()) if len(whole) else -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__y"), pa.array(least, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "y", "least", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = taken.mapInArrow(described, f"doc_id {kind}, y int, least long, ids binary")
    one = sized.groupBy("y", "least").agg(F.min_by("ids", "doc_id").alias("ids"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(y, least, np.frombuffer(ids, dtype="<u4")) for b in batches for y, least, ids in zip(*(b.column(c).to_pylist() for c in ("y", "least", "ids")), strict=True)]
        got.sort(key=lambda r: (r[0], r[1]))
        model = fit([(y, ids) for y, _, ids in got], prior)
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([model.weights[at].astype("<f4").tobytes()], pa.binary())], ["bias", "at", "weights"])

    bounded_batches(spark, 500)
    row = one.repartition(1).mapInArrow(fitted, "bias double, at binary, weights binary").first()
    if row is None:
        return Model(float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0, np.zeros(1 << BITS, dtype=np.float32))
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[np.frombuffer(row.at, dtype="<u4")] = np.frombuffer(row.weights, dtype="<f4")
    return Model(row.bias, weights)


def score_documents(docs: DataFrame, model: Model, out: str = "__toxic") -> DataFrame:
    """docs with the score of the whole text; a map with the model broadcast."""
    masked = Masked(docs, ("doc_id", "text"), (out,))
    spark = docs.sparkSession
    bounded_batches(spark)
    at = np.flatnonzero(model.weights)  # at most MAX_FEATURES
    held = spark.sparkContext.broadcast((model.bias, at, model.weights[at]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, where, values = held.value
        weights = np.zeros(1 << BITS, dtype=np.float32)
        weights[where] = values
        local = Model(bias, weights)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local.scores(raw_texts(batch)), pa.float64())], [*batch.schema.names, "__toxic"])

    schema = T.StructType([*masked.inner.schema.fields, T.StructField("__toxic", T.DoubleType())])
    return masked.back(masked.inner.mapInArrow(scored, schema), "__toxic")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__toxic").alias("score"), (F.col("__toxic") >= 0.5).cast("int").alias("predicted"))
