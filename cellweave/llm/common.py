"""Shared pieces: Arrow batches, vectorised word hashes and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"

_IS_WORD = np.ones(256, dtype=np.int8)
_IS_WORD[list(WHITE)] = 0
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (xor-shift-multiply), vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least n of each."""
    if len(_powers.get("pow", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("pow", _BASE), ("inv", _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["pow"], _powers["inv"]


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-white bytes."""
    flags = np.zeros(len(raw) + 2, dtype=np.int8)
    flags[1:-1] = _IS_WORD[np.frombuffer(raw, dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(flags))
    return edges[::2], edges[1::2]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a UTF-8 text.

    Polynomial prefix sums over pieces of about 1 MB, so that working memory does not follow the
    length of a text beyond its word positions.
    """
    starts, ends = word_bounds(raw)
    out = np.empty(len(starts), dtype=np.uint64)
    buf, lo = np.frombuffer(raw, dtype=np.uint8), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _PIECE, side="right")))
        base = starts[lo]
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        pow_, inv = power_tables(int(e[-1]) + 1)
        sums = np.zeros(e[-1] + 1, dtype=np.uint64)
        np.cumsum((buf[base : base + e[-1]].astype(np.uint64) + np.uint64(1)) * pow_[: e[-1]], out=sums[1:])
        out[lo:hi] = (sums[e] - sums[s]) * inv[s]
        lo = hi
    return starts, ends, mix64(out)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of every run of ``width`` consecutive word hashes (none if there are fewer)."""
    n = len(words)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    pow_, inv = power_tables(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * pow_[:n], out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * inv[: n - width + 1])


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    col = batch.column(name)
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keeps Arrow batches small enough for very long texts; never raises a smaller setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of df has, near to the wanted ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Masked:
    """A frame whose columns have names of our own but for those that an operator reads.

    ``inner`` is what the operator works on: no name in it can clash with a work column (these begin
    with two underscores) or needs quoting. ``back`` gives the names back and adds the operator's
    output columns; columns that had the name of an output column give way to it.
    """

    def __init__(self, df: DataFrame, needed: tuple[str, ...], out: tuple[str, ...]):
        taken = {c.lower() for c in out}
        self.out = out
        self.names = [c for c in df.columns if c.lower() not in taken]
        self.own = [c if c in needed else f"x{i}" for i, c in enumerate(self.names)]
        self.inner = df.select(*[quoted(c).alias(o) for c, o in zip(self.names, self.own, strict=True)])

    def back(self, df: DataFrame, *work: str) -> DataFrame:
        """df has the inner columns and the work columns that become the output, in order."""
        return df.select(*self.own, *work).toDF(*self.names, *self.out)


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """(doc_id) of the ids that stand in several rows, or None: one column is read and counted."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    ids = stored(ids, "repeated-ids", narrow=True)
    return None if ids.isEmpty() else ids


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent (tests, local mode) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="cellweave-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cellweave/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors.

    narrow: rows are a few numbers and made by joins alone, so a sixteenth of the tasks write them.
    """
    path = shared_path(df.sparkSession, name)
    if narrow:
        df = df.coalesce(1 + partitions(df.sparkSession) // 16)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
