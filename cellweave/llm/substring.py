"""Substring dedup (operator 7): suffix automata over reference shards give matching statistics.

A window is ``width`` consecutive words of a document. Every word in a window whose word sequence
also starts in a document with a smaller id is removed; windows are judged on the input.

Which documents could share a window is found by anchors: of the twelve-word hashes inside a window
the least one. Equal windows have the same anchor, and one anchor serves a run of about twenty
windows. Runs whose anchor stands in one document only are done. The others become segments, the
words of a run's windows, and equal segments are one, under their smallest id.

Segments with the same anchor meet in a reference shard, a pack of anchors of bounded size. Its
suffix automaton takes the segments in ascending id, each state remembering the id that first
reached it; the segments then stream through it, and wherever the matching statistic reaches
``width`` the state of that suffix tells the smallest id with the window. Broadcasting every shard to
every document would cost their product, so shards are dealt out by anchor instead.

An anchor that stands in many documents (a frequent line or passage) would make a large shard. Its
windows take the exact way: each is an anchor of its own, told by two 64-bit hashes, and their
smallest ids are found by an aggregation that combines before it shuffles.

Defined cases: null text has no words; rows without id take no part and keep all words; windows of
rows that repeat an id never remove each other; texts of fewer words than a window stay whole; extra
columns play no part; empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix64, raw_texts, stored, window_hashes, word_hashes

WIDTH = 50
ANCHOR_WORDS = 12
#: Documents beyond which an anchor's windows stand alone.
COMMON = 200
#: Bytes of text in a reference shard before it is closed.
SHARD_BYTES = 400_000


def runs(words: np.ndarray, width: int, anchor_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of each run of windows with the same anchor."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = window_hashes(words, anchor_words)
    span = width - anchor_words + 1
    place = np.empty(n, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        view = sliding_window_view(hashes[at : at + (1 << 15) + span - 1], span)
        place[at : at + len(view)] = view.argmin(axis=1) + np.arange(at, at + len(view))
    cuts = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate(([0], cuts))
    return hashes[place[first]], first, np.concatenate((cuts, [n])) - 1


class SuffixAutomaton:
    """A generalised suffix automaton over word sequences; states keep the id that reached them first."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [-1]

    def add(self, words: list[int], owner: int) -> None:
        """Owners must come in ascending order."""
        last = 0
        for word in words:
            last = self._step(last, word, owner)

    def _step(self, last: int, word: int, owner: int) -> int:
        to = self.next[last].get(word)
        if to is not None:
            if self.length[to] == self.length[last] + 1:
                return to
            return self._clone(last, word, to)
        state = self._state(self.length[last] + 1, {}, owner)
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at == -1:
            self.link[state] = 0
        else:
            to = self.next[at][word]
            self.link[state] = to if self.length[to] == self.length[at] + 1 else self._clone(at, word, to)
        return state

    def _state(self, length: int, edges: dict[int, int], owner: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        self.least.append(owner)
        return len(self.next) - 1

    def _clone(self, at: int, word: int, to: int) -> int:
        """A state for the shorter strings of ``to``; they were reached when it was, so it keeps its id."""
        copy = self._state(self.length[at] + 1, dict(self.next[to]), self.least[to])
        self.link[copy], self.link[to] = self.link[to], copy
        while at != -1 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def window_owners(self, words: list[int], width: int) -> list[int]:
        """For each window the smallest id with it, or -1: a stream of matching statistics."""
        out, state, matched = [], 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            to = self.next[state].get(word)
            if to is not None:
                state, matched = to, matched + 1
            if matched > width:  # keep to the suffix of one window
                matched = width
            while state and self.length[self.link[state]] >= matched and matched:
                state = self.link[state]
            if i >= width - 1:
                out.append(self.least[state] if matched >= width else -1)
        return out


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, t, packed): compressed texts under id and hash, for joins that carry texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            blobs = pa.array([pack(raw) for raw in raw_texts(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), blobs], ["doc_id", "t", "packed"])

    return keyed(docs).mapInArrow(run, "doc_id long, t long, packed binary")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")


def shared_anchors(docs: DataFrame, width: int, anchor_words: int, common: int) -> DataFrame:
    """(doc_id, t, anchors): of each document the anchors that others have too; common ones apart."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owner = [np.empty(0, np.uint64)], [0] * batch.num_rows
            for i, raw in enumerate(raw_texts(batch)):
                hashes.append(np.unique(runs(word_hashes(raw)[2], width, anchor_words)[0]))
                owner[i] = len(hashes[-1])
            rows = np.repeat(np.arange(batch.num_rows), owner)
            every = np.concatenate(hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every), batch.column("doc_id").take(pa.array(rows)), batch.column("t").take(pa.array(rows))], ["h", "doc_id", "t"])

    rows = stored(keyed(docs).where("doc_id is not null").mapInArrow(anchors, "h long, doc_id long, t long"), "anchors")
    seen = rows.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    some = rows.join(seen.select("h", (F.col("n") > common).alias("common")), "h")
    return some.groupBy("doc_id", "t").agg(F.collect_set(F.when(~F.col("common"), F.col("h"))).alias("rare"), F.collect_set(F.when(F.col("common"), F.col("h"))).alias("common"))


def segments(texts: DataFrame, anchors: DataFrame, width: int, anchor_words: int) -> DataFrame:
    """(h, s1, s2, words, doc_id, t, first, n): runs under their anchor with the text of their words; that
    is null for single windows."""
    names = ["h", "s1", "s2", "words", "doc_id", "t", "first", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for doc, t, blob, rare, common in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "t", "packed", "rare", "common")), strict=True):
                raw = unpack(blob)
                begin, end, words = word_hashes(raw)
                one = window_hashes(words, width).view(np.int64)
                two = window_hashes(mix64(words ^ np.uint64(0xA5A5A5A5A5A5A5A5)), width).view(np.int64)
                hashes, first, last = runs(words, width, anchor_words)
                hashes = hashes.view(np.int64)
                usual = np.isin(hashes, np.array(rare, dtype=np.int64))
                for h, a, b in zip(hashes[usual].tolist(), first[usual].tolist(), last[usual].tolist(), strict=True):
                    whole = window_hashes(words[a : b + width], b + width - a).view(np.int64)[0]
                    rows.append((h, int(whole), int(one[a] ^ two[b]), raw[begin[a] : end[b + width - 1]], doc, t, a, b - a + 1))
                for a, b in zip(*(x[np.isin(hashes, np.array(common, dtype=np.int64))].tolist() for x in (first, last)), strict=True):
                    rows += [(int(one[i]), int(two[i]), 0, None, doc, t, i, 1) for i in range(a, b + 1)]
                if len(rows) > 4000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)

    return texts.join(anchors, ["doc_id", "t"]).mapInArrow(run, "h long, s1 long, s2 long, words binary, doc_id long, t long, first int, n int")


def shard_owners(distinct: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """(h, s1, s2, owners): smallest id for each window of a segment; one value where it is the same for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, group = [], 0, []  # rows are (h, s1, s2, lo, hi, words)

        def solved() -> Iterator[tuple]:
            automaton, numbers = SuffixAutomaton(), defaultdict(count().__next__)
            split = [[numbers[w] for w in r[5].split()] for r in shard]
            for i in sorted(range(len(shard)), key=lambda i: shard[i][3]):
                automaton.add(split[i], shard[i][3])
            for r, words in zip(shard, split, strict=True):
                owners = automaton.window_owners(words, width)
                if min(owners) < r[4]:
                    yield (*r[:3], owners)

        def closed() -> Iterator[tuple]:
            nonlocal size
            if len(group) == 1 or group[0][5] is None:
                for r in group:
                    if r[3] < r[4]:
                        yield (*r[:3], [r[3]])
            else:
                shard.extend(group)
                size += sum(len(r[5]) for r in group)
                if size >= shard_bytes:
                    yield from solved()
                    shard.clear()
                    size = 0
            group.clear()

        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "s1", "s2", "lo", "hi", "words")), strict=True):
                if group and group[0][0] != row[0]:
                    out += closed()
                group.append(row)
            if out:
                yield batch_of(out)
        out = [*(closed() if group else ()), *(solved() if shard else ())]
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], ["h", "s1", "s2", "owners"])

    dealt = distinct.repartition("h").sortWithinPartitions("h", "lo", "s1", "s2")
    return dealt.select("h", "s1", "s2", "lo", "hi", "words").mapInArrow(run, "h long, s1 long, s2 long, owners array<long>")


def repeated_spans(docs: DataFrame, width: int = WIDTH, anchor_words: int = ANCHOR_WORDS, common: int = COMMON, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, t, spans): first and last word of each maximal removed span, of documents that have any."""
    bounded_batches(docs.sparkSession, 1000)
    anchor_words = min(anchor_words, width)
    anchors = stored(shared_anchors(docs, width, anchor_words, common), "shared-anchors")
    parts = stored(segments(packed(docs), anchors, width, anchor_words), "segments")
    distinct = parts.groupBy("h", "s1", "s2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("words").alias("words"))
    owners = shard_owners(distinct, width, shard_bytes)

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, t, first, n, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "t", "first", "n", "owners")), strict=True):
                flags = np.zeros(n + 2, dtype=np.int8)
                flags[1:-1] = np.array(own) < doc
                edges = np.flatnonzero(np.diff(flags)) + first
                rows += [(doc, t, a, b - 1 + width - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, types, strict=True)], ["doc_id", "t", "first", "last"])

    found = parts.drop("words").join(owners, ["h", "s1", "s2"]).select("doc_id", "t", "first", "n", "owners").mapInArrow(covered, "doc_id long, t long, first int, last int")
    return found.groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that stay, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            total, gone, kept = [], [], []
            for blob, spans_ in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = unpack(blob).split()
                stay, at = [], 0
                for s in spans_ or ():
                    stay += words[at : s["first"]]
                    at = max(at, s["last"] + 1)
                stay += words[at:]
                total.append(len(words))
                gone.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = packed(docs).join(spans.withColumnsRenamed({"doc_id": "__id", "t": "__t"}), (F.col("doc_id") == F.col("__id")) & (F.col("t") == F.col("__t")), "left")
    return joined.select("doc_id", "packed", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    return remove_spans(docs, repeated_spans(docs, width))
