"""Document fingerprints (operator 10): threshold-scaled sketches of word shingles.

A text's shingles are its runs of five words (A-Z lower-cased); with fewer words the whole sequence
is one. The sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of
unequal documents stay comparable: containment of one in the other is estimated without bias, and
the sketch of a union is the union of sketches. Only when no hash of a text with words is below the
fraction does its smallest hash stand alone, which unions respect too.

Likeness of two sketches: hashes in common over the size of the smaller sketch. Two empty sketches
(no words) are alike (1), an empty one and another are not (0).

Defined cases: null text counts as empty; documents come in ascending id, null ids first, rows with
the same id by their text; after the last comes the first; a single document is its own next; extra
columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, window_hashes, word_hashes

FRACTION = 0.25
WIDTH = 5
#: Bits of a hash that a fingerprint keeps.
KEPT_BITS = 48


def sketch(raw: bytes, fraction: float = FRACTION, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 48-bit hashes below fraction * 2^48."""
    _, _, words = word_hashes(raw.lower())
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    hashes = window_hashes(words, min(width, len(words))) >> np.uint64(64 - KEPT_BITS)
    kept = np.unique(hashes[hashes < np.uint64(int(fraction * (1 << KEPT_BITS)))])
    return kept if len(kept) else hashes.min(keepdims=True)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of both shingle sets together."""
    both = np.union1d(a, b)
    kept = both[both < np.uint64(int(fraction * (1 << KEPT_BITS)))]
    return kept if len(kept) else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def to_text(hashes: np.ndarray) -> str:
    """Base64 of the hashes, six bytes each."""
    return base64.b64encode(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (0, 2))).view("<u8").ravel().astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next document's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, text, __bucket, __tail), sorted in ranges of ids, each ended by the row that follows.

    Bounds of the ranges come from approximate quantiles of the ids (a scan of one column). The first
    row of a range goes along with the range before it too, marked __tail; so one shuffle of the
    texts brings every document together with its next.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20000)).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))
    rows = rows.withColumn("__bucket", bucket)
    # at most a row a range reaches the driver
    firsts = sorted((r["__bucket"], r["nulls"] > 0, r["first"]) for r in rows.groupBy("__bucket").agg(F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"), F.min("doc_id").alias("first")).collect())
    if not firsts:
        return rows.withColumn("__tail", F.lit(False))
    tails = [(before[0], null, first) for before, (_, null, first) in zip([firsts[-1], *firsts], firsts, strict=False)]
    marks = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(null).alias("null"), F.lit(f).cast("long").alias("first")) for b, null, f in tails])
    goes = F.transform(F.filter(marks, lambda m: F.when(m["null"], F.col("doc_id").isNull()).otherwise(F.col("doc_id") == m["first"])), lambda m: F.struct(m["bucket"].alias("b"), F.lit(True).alias("t")))
    own = F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("t")))
    dealt = rows.withColumn("__to", F.explode(F.concat(own, F.coalesce(goes, F.array().cast("array<struct<b:int,t:boolean>>")))))
    dealt = dealt.select("doc_id", "text", F.col("__to.b").alias("__bucket"), F.col("__to.t").alias("__tail"))
    return dealt.repartition(partitions(spark), "__bucket").sortWithinPartitions("__bucket", "__tail", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame, fraction: float = FRACTION, width: int = WIDTH) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text, sketch) of the row before

        for batch in batches:
            out = []
            for doc, text, bucket, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "__bucket", "__tail")), strict=True):
                if tail and (held is None or held[0] != bucket):
                    continue  # further rows with the id of the following range's first
                mine = sketch(text.encode(), fraction, width)
                if held is not None and held[0] == bucket:
                    changed = edited(held[2], text).encode()
                    other = sketch(changed, fraction, width)
                    out.append((held[1], len(held[2]), hashlib.sha256(changed).hexdigest(), to_text(held[3]), to_text(other), likeness(held[3], other), likeness(held[3], mine)))
                held = None if tail else (bucket, doc, text, mine)
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return neighbours(docs).mapInArrow(described, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
