"""Line dedup (operator 5): sharded cuckoo filters over exact reference counts.

A line's key is the line without white space at both ends, A-Z lower-cased. The exact table holds,
for each 128-bit key hash, the number of documents with that key. Keys at or above the threshold
stand in cuckoo filters, one a shard of the key space. A filter may also say yes to a few other keys;
these are known exactly, as every key of the corpus stands in the table, and are kept as exceptions.
Filter and exceptions together therefore answer exactly, and the documents are rewritten in one
map-side pass without shuffling a text.

Insertions and deletions of documents add to or take from the counts; keys that cross the threshold
are inserted into or deleted from their shard's filter, so the index is reversible.

Defined cases: null text counts as empty (one empty line); empty keys never drop; rows that repeat an id
count as one document, rows without id as one each; extra columns pass through, and one with the name of an
output column gives way to it; empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, Masked, bounded_batches, raw_texts, repeated_ids, stored

COUNT_SCHEMA = "k1 long, k2 long, n long"
FILTER_SCHEMA = "shard int, n_shards int, table binary, exceptions binary"
OUT = ("__n_lines", "__n_dropped", "__kept")
#: Filters above this many bytes are joined instead of broadcast.
BROADCAST_BYTES = 64 << 20
#: Keys a filter shard is sized for.
SHARD_KEYS = 500_000
#: Keys that stand beside a filter that is too large to broadcast.
BLOCK_KEYS = 20_000


def line_keys(raw: bytes) -> list[bytes]:
    return [x.strip(WHITE) for x in raw.lower().split(b"\n")]


def long_enough(keys: set[bytes], min_chars: int) -> set[bytes]:
    """Keys of at least min_chars code points; never the empty key."""
    return {k for k in keys if k and (min_chars <= 1 or len(k.decode()) >= min_chars)} if min_chars > 1 or b"" in keys else keys


def hash_keys(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as an (n, 2) array of int64."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<i8").reshape(-1, 2)


class CuckooFilter:
    """Buckets of four 32-bit fingerprints; supports insertion, deletion and vectorised lookup.

    Entries that find no place after bounded kicks go to an exact stash, so nothing is lost.
    """

    KICKS = 500

    def __init__(self, capacity: int, table: np.ndarray | None = None, stash: set[tuple[int, int]] | None = None):
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1, capacity / 3.2)))))
        self.table = np.zeros((buckets, 4), dtype=np.uint32) if table is None else table
        self.stash = stash or set()

    @staticmethod
    def _fingerprints(keys: np.ndarray) -> np.ndarray:
        fp = (keys[:, 1].view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        return np.where(fp == 0, np.uint32(1), fp)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = self._fingerprints(keys)
        mask = np.uint64(len(self.table) - 1)
        one = keys[:, 1].view(np.uint64) & mask
        return fp, one.astype(np.int64), (one ^ (self._jump(fp) & mask)).astype(np.int64)

    @staticmethod
    def _jump(fp: np.ndarray) -> np.ndarray:
        return (np.asarray(fp).astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(20)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, dtype=bool)
        fp, one, two = self._places(keys)
        found = ((self.table[one] == fp[:, None]) | (self.table[two] == fp[:, None])).any(axis=1)
        if self.stash:
            found |= np.fromiter((tuple(k) in self.stash for k in keys.tolist()), dtype=bool, count=len(keys))
        return found

    def insert(self, keys: np.ndarray) -> None:
        fps, ones, twos = self._places(keys)
        mask = len(self.table) - 1
        for key, fp, one, two in zip(keys.tolist(), fps.tolist(), ones.tolist(), twos.tolist(), strict=True):
            if self._put(one, fp) or self._put(two, fp):
                continue
            at, moved, trail = two, fp, []
            for kick in range(self.KICKS):
                slot = kick & 3
                trail.append((at, slot))
                self.table[at, slot], moved = moved, int(self.table[at, slot])
                at ^= int(self._jump(np.uint32(moved))) & mask
                if self._put(at, moved):
                    break
            else:  # undo the kicks, so that only the new key needs the stash
                for at, slot in reversed(trail):
                    self.table[at, slot], moved = moved, int(self.table[at, slot])
                self.stash.add(tuple(key))

    def _put(self, at: int, fp: int) -> bool:
        row = self.table[at]
        for slot in range(4):
            if row[slot] == 0:
                row[slot] = fp
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Removes one entry a key; only keys that were inserted may be deleted."""
        fps, ones, twos = self._places(keys)
        for key, fp, one, two in zip(keys.tolist(), fps.tolist(), ones.tolist(), twos.tolist(), strict=True):
            if tuple(key) in self.stash:
                self.stash.discard(tuple(key))
                continue
            for at in (one, two):
                slot = np.flatnonzero(self.table[at] == fp)
                if len(slot):
                    self.table[at, slot[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        stash = np.array(sorted(self.stash), dtype="<i8").reshape(-1, 2).tobytes()
        return len(self.table).to_bytes(8, "little") + self.table.astype("<u4").tobytes() + stash

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        buckets = int.from_bytes(blob[:8], "little")
        table = np.frombuffer(blob, dtype="<u4", count=buckets * 4, offset=8).reshape(-1, 4).copy()
        stash = np.frombuffer(blob, dtype="<i8", offset=8 + buckets * 16).reshape(-1, 2)
        return cls(1, table, {tuple(k) for k in stash.tolist()})


class Membership:
    """All shards' filters with their exceptions: exact for every key of the corpus they come from."""

    def __init__(self, rows: list[tuple[int, int, bytes, bytes]]):
        self.n_shards = rows[0][1] if rows else 1
        self.filters = {shard: CuckooFilter.from_bytes(table) for shard, _, table, _ in rows}
        self.exceptions = {tuple(k) for row in rows for k in np.frombuffer(row[3], dtype="<i8").reshape(-1, 2).tolist()}

    def contains(self, keys: np.ndarray) -> np.ndarray:
        found = self.maybe(keys)
        if self.exceptions:
            for i in np.flatnonzero(found):
                found[i] = tuple(keys[i].tolist()) not in self.exceptions
        return found

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        found, shard = np.zeros(len(keys), dtype=bool), np.mod(keys[:, 0], self.n_shards)
        for s, one in self.filters.items():
            at = np.flatnonzero(shard == s)
            found[at] = one.contains(keys[at])
        return found


def count_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(k1, k2, n): the exact number of documents with each line key of at least min_chars.

    Rows are counted, which combines before the shuffle; only rows that repeat an id are looked at by id.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    again = repeated_ids(docs)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            keys = hash_keys(list(seen))
            batch = pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(seen.values()), pa.int64())], ["k1", "k2", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for raw in raw_texts(batch):
                keys = set(line_keys(raw))
                seen.update(long_enough(keys, min_chars))
            if len(seen) >= 100_000:
                yield out()
        if seen:
            yield out()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id"), raw_texts(batch), strict=True):
                keys = hash_keys(list(long_enough(set(line_keys(raw)), min_chars)))
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(keys), doc.type), pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["doc_id", "k1", "k2"])

    once = docs if again is None else docs.join(again, "doc_id", "left_anti")
    parts = once.select("text").mapInArrow(counted, COUNT_SCHEMA)
    if again is not None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = docs.join(again, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(listed, f"doc_id {kind}, k1 long, k2 long").distinct()
        parts = parts.unionByName(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")))
    return parts.groupBy("k1", "k2").agg(F.sum("n").alias("n"))


def merge_counts(counts: DataFrame, delta: DataFrame, sign: int = 1) -> DataFrame:
    """Counts after inserting (sign 1) or deleting (sign -1) the documents that delta was counted on."""
    both = counts.select("k1", "k2", "n").unionByName(delta.select("k1", "k2", (F.col("n") * sign).alias("n")))
    return both.groupBy("k1", "k2").agg(F.sum("n").alias("n")).where("n > 0")


def build_filters(counts: DataFrame, min_docs: int = 10, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One filter row a shard, from a stored table of counts."""
    spark = counts.sparkSession
    hot = counts.where(F.col("n") >= min_docs)
    n_shards = 1 + hot.count() // shard_keys

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list[np.ndarray]] = {}
        for b in batches:
            keys = np.stack([b.column("k1").to_numpy(), b.column("k2").to_numpy()], axis=1)
            for s in np.unique(np.mod(keys[:, 0], n_shards)).tolist():
                shards.setdefault(s, []).append(keys[np.mod(keys[:, 0], n_shards) == s])
        for s, parts in shards.items():
            keys = np.concatenate(parts)
            one = CuckooFilter(len(keys))
            one.insert(keys)
            yield _filter_row(s, n_shards, one, b"")

    shard = F.pmod("k1", F.lit(n_shards))
    filters = stored(hot.select("k1", "k2").repartition(n_shards, shard).mapInArrow(built, FILTER_SCHEMA), "line-filters")
    return _with_exceptions(spark, filters, counts.where(F.col("n") < min_docs), n_shards)


def _filter_row(shard: int, n_shards: int, one: CuckooFilter, exceptions: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([n_shards], pa.int32()), pa.array([one.to_bytes()], pa.binary()), pa.array([exceptions], pa.binary())],
        ["shard", "n_shards", "table", "exceptions"],
    )


def _with_exceptions(spark, filters: DataFrame, others: DataFrame, n_shards: int) -> DataFrame:
    """Adds to each shard the keys that its filter answers yes to although they are below the threshold."""
    others = others.select("k1", "k2")
    if fits(filters):
        held = spark.sparkContext.broadcast(_rows(filters))

        def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            member = Membership(held.value)
            for b in batches:
                keys = np.stack([b.column("k1").to_numpy(), b.column("k2").to_numpy()], axis=1)
                yield b.filter(pa.array(member.maybe(keys)))

        wrong = others.mapInArrow(tested, "k1 long, k2 long")
    else:
        # one shard's filter stands beside a bounded block of its keys
        n_blocks = 1 + others.count() // (n_shards * BLOCK_KEYS)
        blocks = others.groupBy(F.pmod("k1", F.lit(n_shards)).cast("int").alias("shard"), F.pmod("k2", F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("k1", "k2")).alias("ks"))

        def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    keys = np.array([(k["k1"], k["k2"]) for k in row["ks"]], dtype=np.int64).reshape(-1, 2)
                    keys = keys[CuckooFilter.from_bytes(row["table"]).contains(keys)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["k1", "k2"])

        wrong = blocks.join(filters.select("shard", "table"), "shard").select("table", "ks").mapInArrow(tested, "k1 long, k2 long")
    wrong = wrong.groupBy(F.pmod("k1", F.lit(n_shards)).cast("int").alias("shard")).agg(F.collect_list(F.struct("k1", "k2")).alias("wrong"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                keys = np.array([(k["k1"], k["k2"]) for k in r["wrong"] or []], dtype="<i8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]], pa.int32()), pa.array([r["n_shards"]], pa.int32()), pa.array([r["table"]], pa.binary()), pa.array([keys], pa.binary())],
                    ["shard", "n_shards", "table", "exceptions"],
                )

    return stored(filters.drop("exceptions").join(wrong, "shard", "left").mapInArrow(packed, FILTER_SCHEMA), "line-filters")


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, min_docs: int = 10) -> DataFrame:
    """Filters after the counts changed: keys that crossed the threshold are inserted or deleted.

    Only the crossing keys reach the filters; exceptions are found anew from the counts after.
    """
    spark = filters.sparkSession
    n_shards = (filters.select("n_shards").first() or [1])[0]
    a, b = before.where(F.col("n") >= min_docs).select("k1", "k2"), after.where(F.col("n") >= min_docs).select("k1", "k2")
    moved = b.join(a, ["k1", "k2"], "left_anti").withColumn("up", F.lit(True)).unionByName(a.join(b, ["k1", "k2"], "left_anti").withColumn("up", F.lit(False)))
    moved = moved.groupBy(F.pmod("k1", F.lit(n_shards)).cast("int").alias("shard")).agg(F.collect_list(F.struct("k1", "k2", "up")).alias("moved"))

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = r["moved"] or []
                one = CuckooFilter.from_bytes(r["table"]) if r["table"] else CuckooFilter(len(rows))
                for up, act in ((False, one.delete), (True, one.insert)):
                    act(np.array([(k["k1"], k["k2"]) for k in rows if k["up"] == up], dtype=np.int64).reshape(-1, 2))
                yield _filter_row(r["shard"], n_shards, one, b"")

    fresh = stored(filters.drop("exceptions").join(moved, "shard", "full").mapInArrow(changed, FILTER_SCHEMA), "line-filters")
    return _with_exceptions(spark, fresh, after.where(F.col("n") < min_docs), n_shards)


def fits(filters: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    total = filters.select(F.sum(F.length("table") + F.length("exceptions"))).first()[0]
    return (total or 0) <= limit


def _rows(filters: DataFrame) -> list[tuple[int, int, bytes, bytes]]:
    """Only called on filters whose size was checked."""
    return [(r.shard, r.n_shards, bytes(r.table), bytes(r.exceptions)) for r in filters.collect()]


def _rewritten(batch: pa.RecordBatch, dropped_of: list[set[bytes]], keys_of: list[list[bytes]]) -> pa.RecordBatch:
    total, gone, kept = [], [], []
    for raw, keys, dropped in zip(raw_texts(batch), keys_of, dropped_of, strict=True):
        lines = raw.split(b"\n")
        stay = lines if not dropped else [x for x, k in zip(lines, keys, strict=True) if k not in dropped]
        total.append(len(lines))
        gone.append(len(lines) - len(stay))
        kept.append(raw if len(stay) == len(lines) else b"\n".join(stay))
    extra = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *OUT])


def drop_lines(docs: DataFrame, filters: DataFrame, min_chars: int = 1, limit: int = BROADCAST_BYTES, out: tuple[str, str, str] = OUT) -> DataFrame:
    """docs with three columns named by ``out``: lines, dropped lines, and the text without those in the index.

    Filters up to ``limit`` bytes are broadcast; larger ones meet the distinct keys of the documents
    in a join on the shard, and each document gets its dropped keys by a join on a row number.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    masked = Masked(docs, ("doc_id", "text"), out)
    docs = masked.inner
    schema = T.StructType([*docs.schema.fields, T.StructField(OUT[0], T.LongType()), T.StructField(OUT[1], T.LongType()), T.StructField(OUT[2], T.StringType())])
    if fits(filters, limit):
        held = spark.sparkContext.broadcast(_rows(filters))

        def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            member = Membership(held.value)
            for batch in batches:
                keys_of = [line_keys(raw) for raw in raw_texts(batch)]
                every = list(long_enough(set().union(*keys_of), min_chars))
                hits = set()
                if every:
                    hits = {every[i] for i in np.flatnonzero(member.contains(hash_keys(every))).tolist()}
                yield _rewritten(batch, [hits] * len(keys_of), keys_of)

        return masked.back(docs.mapInArrow(rewritten, schema), *OUT)

    row = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.coalesce("text", F.lit(""))))
    number = docs.withColumn("__row", row)
    n_shards = filters.select("n_shards").first()[0]

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for row, raw in zip(batch.column("__row").to_pylist(), raw_texts(batch), strict=True):
                mine = list(long_enough(set(line_keys(raw)), min_chars))
                rows += [row] * len(mine)
                keys += mine
            if keys:
                h = hash_keys(keys)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["__row", "k1", "k2"])

    lines = number.select("__row", "text").mapInArrow(exploded, "__row string, k1 long, k2 long")
    every = stored(lines.select("k1", "k2").distinct(), "line-keys")
    block = F.pmod("k2", F.lit(1 + every.count() // (n_shards * BLOCK_KEYS))).alias("block")
    blocks = every.groupBy(F.pmod("k1", F.lit(n_shards)).cast("int").alias("shard"), block).agg(F.collect_list(F.struct("k1", "k2")).alias("ks"))

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                keys = np.array([(k["k1"], k["k2"]) for k in r["ks"]], dtype=np.int64).reshape(-1, 2)
                keys = keys[Membership([(r["shard"], r["n_shards"], r["table"], r["exceptions"])]).contains(keys)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["k1", "k2"])

    hits = blocks.join(filters, "shard").mapInArrow(tested, "k1 long, k2 long")
    drops = lines.join(hits, ["k1", "k2"]).groupBy("__row").agg(F.collect_set(F.struct("k1", "k2")).alias("__drops"))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys_of, dropped_of = [], []
            for raw, drops in zip(raw_texts(batch), batch.column("__drops").to_pylist(), strict=True):
                keys = line_keys(raw)
                mine = list(long_enough(set(keys), min_chars))
                want = {(d["k1"], d["k2"]) for d in drops or []}
                dropped_of.append({k for k, h in zip(mine, hash_keys(mine).tolist(), strict=True) if tuple(h) in want} if want else set())
                keys_of.append(keys)
            yield _rewritten(batch.drop_columns(["__row", "__drops"]), dropped_of, keys_of)

    return masked.back(number.join(drops, "__row", "left").select(*docs.columns, "__row", "__drops").mapInArrow(applied, schema), *OUT)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, out: tuple[str, str, str] = OUT) -> DataFrame:
    """Counts, filters and rewrites: docs with three columns named by ``out``."""
    counts = stored(count_lines(docs, min_chars), "line-counts")
    return drop_lines(docs, build_filters(counts, min_docs), min_chars, out=out)


def digest(deduped: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_lines, n_dropped, kept_sha256."""
    return deduped.select("doc_id", F.col(OUT[0]).alias("n_lines"), F.col(OUT[1]).alias("n_dropped"), F.sha2(F.col(OUT[2]), 256).alias("kept_sha256"))
