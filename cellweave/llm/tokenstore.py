"""Token-ID files (operator 2): one concatenated id array a shard, Elias-Fano document boundaries.

A shard holds the ids of consecutive documents back to back (16-bit where the ids allow, else 32-bit)
and the documents' boundaries as an Elias-Fano sequence: the low bits of each boundary packed, the
high bits in unary in a bit vector, with a 32-bit sample of every 256th set bit, so that select
returns an offset after a scan of a few words. Boundaries cost about 2 + log2(ids / documents) bits.

Shards are rows of a table in the shared folder, (part, seq) in ascending document order, written
and committed by Spark, so that lost tasks leave nothing behind and any file system will do.

Defined cases: null text counts as empty and holds only the end id; null ids come first; rows that
repeat an id stand together, in the order of their ids' bytes; extra columns play no part; an empty
table makes an empty store.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import gathered
from .common import bounded_batches, partitions, shared_path

MAGIC = b"EFT1"
SAMPLE = 256
#: Ids in a shard before a new one begins; a longer document has a shard of its own.
SHARD_IDS = 1 << 19
#: Texts gathered before their new chunks are encoded together, in bytes.
GATHER_BYTES = 4 << 20
#: Chunks remembered by a worker's encoder; beyond that memory starts afresh.
MEMORY = 900_000

#: The characters with the Unicode property White_Space, and letters of Latin-1.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_chunks = re.compile(f" ?[{_LETTER}]+(?![^{_SPACE}.,;:!?])| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]").findall


#: The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on.
_ALPHABET = {}
for _byte in range(256):
    _ALPHABET[_byte] = _byte if 33 <= _byte <= 126 or 161 <= _byte <= 172 or _byte >= 174 else 256 + len([b for b, c in _ALPHABET.items() if c >= 256])


class EliasFano:
    """A non-decreasing sequence of integers below 2^40 or so, in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples
        self.bytes = high.tobytes()  # for select, which looks at single bytes

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values, n = np.asarray(values, dtype=np.uint64), len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(ones[-1]) + 1) if n else 0, dtype=np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Value i: the place of the i-th set bit gives the high part, found from the sample before."""
        at, left, high = int(self.samples[i // SAMPLE]), i % SAMPLE, self.bytes
        byte = at >> 3
        left += (high[byte] & ((1 << (at & 7)) - 1)).bit_count()  # set bits before the sample in its byte
        while left >= (ones := high[byte].bit_count()):
            left -= ones
            byte += 1
        word = high[byte]
        for _ in range(left):
            word &= word - 1
        place = (byte << 3) + (word & -word).bit_length() - 1
        first = i * self.low_bits
        low = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little") >> (first & 7)
        return ((place - i) << self.low_bits) | (low & ((1 << self.low_bits) - 1))

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else np.zeros(self.n, dtype=np.int64)
        return ((ones - np.arange(self.n)) << self.low_bits) | low

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)], dtype="<u4")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> EliasFano:
        n, low_bits, n_low, n_high, n_samples = np.frombuffer(blob, dtype="<u4", count=5).tolist()
        low = np.frombuffer(blob, dtype=np.uint8, count=n_low, offset=20)
        high = np.frombuffer(blob, dtype=np.uint8, count=n_high, offset=20 + n_low)
        return cls(n, low_bits, low, high, np.frombuffer(blob, dtype="<u4", count=n_samples, offset=20 + n_low + n_high))


class Shard:
    """An id array with its document boundaries (one more than documents, from 0)."""

    def __init__(self, ids: np.ndarray, bounds: EliasFano):
        self.ids, self.bounds = ids, bounds

    @classmethod
    def pack(cls, documents: list[np.ndarray]) -> bytes:
        ids = np.concatenate(documents)
        width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
        bounds = EliasFano.build(np.cumsum([0, *map(len, documents)])).to_bytes()
        return MAGIC + bytes([width]) + len(bounds).to_bytes(4, "little") + bounds + ids.astype(f"<u{width}").tobytes()

    @classmethod
    def unpack(cls, blob: bytes) -> Shard:
        if blob[:4] != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(blob[5:9], "little")
        return cls(np.frombuffer(blob, dtype=f"<u{blob[4]}", offset=9 + size), EliasFano.from_bytes(blob[9 : 9 + size]))

    def document(self, i: int) -> np.ndarray:
        """Ids of document i, with two selects and no table of offsets."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


class ChunkEncoder:
    """The tokenizers library behind a memory of chunks.

    Texts split where the byte-level pattern always splits: before a single space that follows a
    non-space, before or after a run of white space, and between a word and punctuation after it. The library
    encodes each new chunk once. Texts that hold an added token of the file (such as an end-of-text
    mark spelled out) go to the library whole, as does every text if the file is not byte-level.
    """

    def __init__(self, blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob.decode())
        split, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        plain = self.tokenizer.normalizer is None and self.tokenizer.truncation is None and self.tokenizer.padding is None
        self.byte_level = plain and type(split).__name__ == "ByteLevel" and split.use_regex and not split.add_prefix_space and self._ids_of("A b") == [t.id for w in ("A", "\u0120b") for t in model.tokenize(w)]
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.holds_added = re.compile("|".join(map(re.escape, added))).search if added else None
        self.forget()

    def _ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.index: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids, self.offsets = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.index) > MEMORY:
            self.forget()
        numbered = []
        for t in texts:
            if not self.byte_level or self.holds_added and self.holds_added(t):
                numbered.append(t)
                continue
            chunks = _chunks(t)
            numbered.append(np.fromiter(map(self.index.__getitem__, chunks), dtype=np.int32, count=len(chunks)))
        got = self._encoded(list(islice(self.index, len(self.offsets) - 1, None)))
        lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(got), dtype=np.int32, count=int(lengths.sum()))))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(lengths)))
        return (np.array(self._ids_of(n), dtype=np.int32) if isinstance(n, str) else self._ids(n) for n in numbered)

    def _encoded(self, new: list[str]) -> list[list[int]]:
        """Ids of each chunk. A chunk of letters is one piece, which the library's model takes in the
        byte-level alphabet; the others go through the whole tokenizer."""
        tokenize, out, rest = self.tokenizer.model.tokenize, [], []
        gc.disable()  # many small lists and no cycles
        for i, chunk in enumerate(new):
            word = chunk[1:] if chunk[0] == " " else chunk
            if word.isalpha():
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(_ALPHABET)
                out.append([t.id for t in tokenize(spelled if word is chunk else "\u0120" + spelled)])
            else:
                out.append(None)
                rest.append(i)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([new[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = e.ids
        gc.enable()
        return out

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        begin = self.offsets[numbers]
        lengths = self.offsets[numbers + 1] - begin
        return self.ids[np.repeat(begin - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))]


_encoders: dict[str, ChunkEncoder] = {}


def worker_encoder(blob: bytes) -> ChunkEncoder:
    name = hashlib.sha256(blob).hexdigest()
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = ChunkEncoder(blob)
    return _encoders[name]


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """(doc_id, wide, ids): each text's ids and the end id, little-endian in 16 bits or, if wide, 32."""
    spark = docs.sparkSession
    bounded_batches(spark, 1000)
    with open(tokenizer, "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(blob.value)
        for batch in gathered(batches, GATHER_BYTES):
            ids, wide = [], []
            for tokens in enc.encode([t or "" for t in batch.column("text").to_pylist()]):
                wide.append(bool(len(tokens) and tokens.max() >> 16 or end_id >> 16))
                ids.append(np.append(tokens, np.int32(end_id)).astype("<u4" if wide[-1] else "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(wide, pa.bool_()), pa.array(ids, pa.binary())], ["doc_id", "wide", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, wide boolean, ids binary")


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, shard_ids: int = SHARD_IDS) -> str:
    """Encodes docs and writes their shards; returns the store's path.

    Texts are encoded where they are read; only ids are shuffled, once, to ranges of document ids
    whose bounds come from approximate quantiles of the id column. Each range is sorted and cut into
    shards as it streams by.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20000)).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, size, seq = None, [], [], 0, 0
        id_type = pa.int64()

        def out() -> pa.RecordBatch:
            columns = [pa.array([now], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([Shard.pack(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "n_ids", "doc_ids", "blob"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc, own, wide, tokens in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "wide", "ids")), strict=True):
                if held and (own != now or size >= shard_ids):
                    yield out()
                    ids, held, size, seq = [], [], 0, seq + 1 if own == now else 0
                now = own
                ids.append(doc)
                held.append(np.frombuffer(tokens, dtype="<u4" if wide else "<u2").astype(np.uint32))
                size += len(held[-1])
        if held:
            yield out()

    path = path or shared_path(spark, "tokens")
    dealt = encoded(docs, tokenizer, end_id).withColumn("part", part).repartition(partitions(spark), "part").sortWithinPartitions("part", "doc_id", "ids")
    dealt.mapInArrow(shards, f"part int, seq int, n_ids long, doc_ids array<{kind}>, blob binary").write.option("compression", "none").parquet(path)  # ids hardly compress
    return path


def shard_starts(store: DataFrame) -> DataFrame:
    """(part, seq, start): ids in all shards before. Totals of the parts, which are as many as write_store
    dealt out whatever the input, are summed up in one task; shards within their part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    shards = store.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("start"))
    return shards.join(parts, "part").select("part", "seq", (F.col("base") + F.col("start")).alias("start"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files, its bounds by select.

    A task holds the shards of one input split, so spark.sql.files.maxPartitionBytes bounds it.
    """
    store = spark.read.parquet(path)
    kind = store.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard.unpack(batch.column("blob")[i].as_py())
                doc_ids = batch.column("doc_ids")[i].values
                n, end = len(doc_ids), shard.bounds.select(0)
                local, size, sums = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
                for j in range(n):
                    begin, end = end, shard.bounds.select(j + 1)
                    local[j], size[j], sums[j] = begin, end - begin, zlib.crc32(shard.ids[begin:end].astype("<u4"))
                columns = [pa.array([batch.column("part")[i].as_py()] * n, pa.int32()), pa.array([batch.column("seq")[i].as_py()] * n, pa.int32()), doc_ids, pa.array(local), pa.array(size), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = store.select("part", "seq", "doc_ids", "blob").mapInArrow(documents, f"part int, seq int, doc_id {kind}, local long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(store), ["part", "seq"]).select("doc_id", (F.col("start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
