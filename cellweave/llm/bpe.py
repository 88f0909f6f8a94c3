"""Byte-level BPE encoding and decoding (operator 9) with a hierarchical-bitmap rank queue.

All pre-tokens that a batch brings for the first time stand in one linked list of nodes, joined over
their bytes; a node is a token so far. Every adjacent pair with a merge stands in the bucket of its
rank, buckets hold list positions. A bitmap in three levels (64 bits a word) marks the ranks whose
bucket is not empty; find-first-set over the levels gives the next rank. A bucket's positions are
merged together; entries whose pair has changed since are stale and skipped. As pre-tokens never
share a pair, this does for each pre-token exactly what merging its lowest-ranked, leftmost pair
again and again does, and costs little more for a pre-token of a million bytes than for short ones.

Defined cases: null text counts as empty and gives no ids; repeated rows, extra columns and very long
pre-tokens need nothing special; empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches

NONE = np.int32(2**31 - 1)
#: Texts gathered before their unseen pre-tokens are merged together, in bytes.
GATHER_BYTES = 8 << 20
#: Pre-tokens remembered in a worker; beyond that memory starts afresh.
MEMORY = 250_000


def load_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines with a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in blob.splitlines() if x.strip())}


class RankQueue:
    """Buckets of positions by rank under a three-level bitmap."""

    def __init__(self, n_ranks: int):
        self.levels = []
        while True:
            n_ranks = (n_ranks + 63) // 64
            self.levels.append([0] * n_ranks)
            if n_ranks == 1:
                break
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        at = rank
        for words in self.levels:
            word, bit = at >> 6, 1 << (at & 63)
            if words[word] & bit:
                break
            words[word] |= bit
            at = word

    def pop(self) -> tuple[int, list[np.ndarray]] | None:
        """The lowest rank with its bucket, by find-first-set from the top level down."""
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            if not word:
                return None
            at = (at << 6) | ((word & -word).bit_length() - 1)
        rank = at
        for words in self.levels:
            words[at >> 6] &= ~(1 << (at & 63))
            if words[at >> 6]:
                break
            at >>= 6
        return rank, self.buckets.pop(rank)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts), strict=True):
            self.push(rank, part)


class MergeTable:
    """Pairs of token ids that merge, in an open-addressing table; the id of a token is its rank."""

    SIZE_BITS = 20

    def __init__(self, ranks: dict[bytes, int]):
        self.n = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.n
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(self.n)]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    merged.append(rank)
        self._fill(np.array(keys, dtype=np.uint64), np.array(merged, dtype=np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(self.SIZE_BITS, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, 2**64 - 1, dtype=np.uint64), np.full(size, NONE, dtype=np.int32)
        slots, self.reach = self._slot(keys), 0
        while len(keys):
            self.reach += 1
            free = np.flatnonzero(self.values[slots] == NONE)
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], merged[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            keys, merged, slots = keys[rest], merged[rest], (slots[rest] + 1) & (size - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it does not merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots, mask = self._slot(keys), (1 << self.bits) - 1
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (self.values[slots] != NONE))
        for _ in range(self.reach):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & mask
            at = slots[open_]
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.values[at] != NONE)]
        return out


def encode_pieces(table: MergeTable, pieces: list[bytes], whole: list[int | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and the offset of each piece's first id (and the end).

    whole: the id of each piece that is a token itself, else None.
    """
    if whole is not None and any(w is not None for w in whole):
        ids, offsets = encode_pieces(table, [p for p, w in zip(pieces, whole, strict=True) if w is None])
        counts = np.ones(len(pieces), dtype=np.int64)
        merged = np.fromiter((w is None for w in whole), dtype=bool, count=len(whole))
        counts[merged] = np.diff(offsets)
        ends = np.concatenate(([0], np.cumsum(counts)))
        out, alone = np.empty(ends[-1], dtype=np.int32), np.zeros(ends[-1], dtype=bool)
        alone[ends[:-1][~merged]] = True
        out[alone], out[~alone] = [w for w in whole if w is not None], ids
        return out, ends
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    n = int(starts[-1])
    end = n  # stands after the last node of every piece; its id merges with nothing
    tok = np.empty(n + 1, dtype=np.int32)
    tok[:n], tok[n] = table.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)], table.n
    nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    full = starts[:-1][lengths > 0]
    nxt[starts[1:][lengths > 0] - 1] = end
    prv[full] = end
    rank = np.full(n + 1, NONE, dtype=np.int32)
    for i in range(0, n, 1 << 18):
        rank[i : min(n, i + (1 << 18))] = table.ranks(tok[i : min(n, i + (1 << 18))], tok[nxt[i : min(n, i + (1 << 18))]])
    alive = np.ones(n + 1, dtype=bool)
    odd: list[np.ndarray] = []  # positions where a merge made a lower rank than its own
    queue = RankQueue(table.n)
    at = np.flatnonzero(rank[:n] != NONE).astype(np.int32)
    if len(at):
        queue.push_all(rank[at], at)
    while (got := queue.pop()) is not None:
        r, parts = got
        pos = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        pos = pos[rank[pos] == r]
        if not len(pos):
            continue
        touching = nxt[pos[:-1]] == pos[1:]
        if touching.any():  # runs of one token: take every second pair from the left
            index = np.arange(len(pos))
            first = np.maximum.accumulate(np.where(np.concatenate(([True], ~touching)), index, 0))
            pos = pos[(index - first) & 1 == 0]
        gone = nxt[pos]
        after = nxt[gone]
        tok[pos] = r
        rank[gone], alive[gone] = NONE, False
        nxt[pos] = after
        prv[after] = pos
        before = prv[pos]
        before = before[before != end]
        changed = np.concatenate((before, pos))
        fresh = table.ranks(tok[changed], tok[nxt[changed]])
        rank[changed] = fresh
        rank[end] = NONE
        if (fresh < r).any():
            odd.append(changed[fresh < r])
        some = fresh != NONE
        if some.any():
            queue.push_all(fresh[some], changed[some])
    live = np.flatnonzero(alive[:n])
    ids, offsets = tok[live], np.searchsorted(live, starts)
    if odd:  # a merge met a lower rank: such a piece is done again on its own, pair by pair
        wrong = set((np.searchsorted(starts, np.concatenate(odd), side="right") - 1).tolist())
        parts = [encode_one(table, p) if i in wrong else ids[offsets[i] : offsets[i + 1]] for i, p in enumerate(pieces)]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return np.concatenate(parts), offsets
    return ids, offsets


def encode_one(table: MergeTable, piece: bytes) -> np.ndarray:
    """The same queue with one pair merged at a time: the lowest rank, leftmost."""
    ids, end = table.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist(), len(piece)
    nxt, prv = list(range(1, end + 1)), list(range(-1, end - 1))

    def rank_at(p: int) -> int:
        if p < 0 or nxt[p] >= end:
            return int(NONE)
        return int(table.ranks(np.array([ids[p]]), np.array([ids[nxt[p]]]))[0])

    now = [rank_at(p) for p in range(end)]
    queue = RankQueue(table.n)
    for p, r in enumerate(now):
        if r != NONE:
            queue.push(r, p)
    alive = [True] * end
    while (got := queue.pop()) is not None:
        r, held = got
        held = sorted({p for p in held if alive[p] and now[p] == r})
        if not held:
            continue
        p, rest = held[0], held[1:]
        for q in rest:
            queue.push(r, q)
        gone = nxt[p]
        ids[p], alive[gone], now[gone], nxt[p] = r, False, int(NONE), nxt[gone]
        if nxt[p] < end:
            prv[nxt[p]] = p
        for q in (prv[p], p):
            if q >= 0:
                now[q] = rank_at(q)
                if now[q] != NONE:
                    queue.push(now[q], q)
    return np.array([t for t, a in zip(ids, alive, strict=True) if a], dtype=np.int32)


class Encoder:
    """Splits texts by a pattern and remembers the ids of pre-tokens it has met.

    Pre-tokens get numbers in the order they are met; their ids stand one after another in one array.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.table, self.split = ranks, MergeTable(ranks), regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.index: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids, self.offsets = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def number(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, self.split(text)), dtype=np.int32)

    def learn(self) -> None:
        """Encodes the pre-tokens that were numbered since the last call, all together."""
        known = len(self.offsets) - 1
        new = [w.encode() for w in islice(self.index, known, None)]
        if new:
            whole = [self.ranks.get(p) for p in new]  # a whole token needs no merges
            ids, offsets = encode_pieces(self.table, new, whole)
            self.offsets = np.concatenate((self.offsets, offsets[1:] + self.offsets[-1]))
            self.ids = np.concatenate((self.ids, ids))

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        begin = self.offsets[numbers]
        lengths = self.offsets[numbers + 1] - begin
        shift = np.repeat(begin - np.cumsum(lengths) + lengths, lengths)
        return self.ids[shift + np.arange(len(shift))]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.index) > MEMORY:
            self.forget()
        numbered = [self.number(t) for t in texts]
        self.learn()
        return map(self.ids_of, numbered)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.tokens.__getitem__, ids))


_encoders: dict[str, Encoder] = {}


def worker_encoder(blob: bytes, pattern: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker, kept between tasks."""
    name = hashlib.sha256(blob + pattern.encode()).hexdigest()
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(load_ranks(blob), pattern)
    return _encoders[name]


def gathered(batches: Iterator[pa.RecordBatch], limit: int = GATHER_BYTES) -> Iterator[pa.RecordBatch]:
    """Joins small batches up to a size, so that their unseen pre-tokens are merged together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (whole := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield whole.to_batches()[0]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document.

    The driver reads the vocabulary file; its bytes (about 1 MB) are broadcast. A document's ids live
    only in the task that hashes them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(vocabulary, "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(blob.value, pattern)
        names = enc.table.names.__getitem__
        for batch in gathered(batches):
            counts, sums, decoded = [], [], []
            for ids in enc.encode([t or "" for t in batch.column("text").to_pylist()]):
                listed = ids.tolist()
                counts.append(len(listed))
                sums.append(hashlib.sha256(" ".join(map(names, listed)).encode()).hexdigest())
                decoded.append(hashlib.sha256(enc.decode(listed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        if len(enc.index) > MEMORY // 2:  # idle workers do not sit on what other stages need
            enc.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
