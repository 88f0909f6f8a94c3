"""Token counts (operator 3): unigram segmentation shared over a trie of distinct pre-tokens.

Each text splits into pre-tokens; a pre-token's best segmentation is the sequence of vocabulary
pieces with the largest sum of log probabilities, and among equal sums the fewest pieces. The
distinct pre-tokens that a batch brings for the first time are walked in sorted order, which is a
depth-first walk of their trie: the forward scores of a prefix stand on the walk's stack and are
computed once for all pre-tokens below it. Where a pre-token ends its count is stored, and a
document's count is the sum over its pre-tokens.

Piece scores are integers (log probabilities in 2^-16 nats), so sums are exact and the same in any
order. A rank file gives them by Zipf's law: probability proportional to 1 / (rank + 1).

Defined cases: null text counts as empty, with no tokens; repeated rows and extra columns play no
part; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import gathered, load_ranks
from .common import bounded_batches

#: Pre-tokens remembered by a worker; beyond that memory starts afresh.
MEMORY = 500_000


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Costs (negated log probabilities in 2^-16 nats) of the pieces of a rank file."""
    total = sum(1 / (r + 1) for r in ranks.values())
    return {piece: round((math.log(r + 1) + math.log(total)) * 65536) for piece, r in ranks.items()}


class TrieCounter:
    """Counts of the best segmentation, for many words along their shared prefixes."""

    def __init__(self, costs: dict[bytes, int], pattern: str):
        # one number orders by cost and then by pieces: cost * 2^40 + 1 for each piece
        self.costs = {piece: (cost << 40) + 1 for piece, cost in costs.items()}
        lengths: dict[int, set[int]] = defaultdict(set)
        for piece in costs:
            lengths[piece[-1]].add(len(piece))
        self.lengths = [sorted(lengths.get(b, ())) for b in range(256)]
        self.split = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.index: defaultdict[str, int] = defaultdict(count().__next__)
        self.counts = np.empty(0, dtype=np.int64)

    def walk(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(cost, pieces) of each of the sorted words."""
        costs, lengths = self.costs, self.lengths
        forward, last = [0], b""  # forward[d]: best score of the first d bytes of the walk's path
        never = 1 << 120
        for word in words:
            shared, most = 0, min(len(last), len(word))
            if word[:most] == last[:most]:
                shared = most
            else:
                while word[shared] == last[shared]:
                    shared += 1
            del forward[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best = never
                for n in lengths[word[end - 1]]:
                    if n > end:
                        break
                    cost = costs.get(word[end - n : end])
                    if cost is not None and (total := forward[end - n] + cost) < best:
                        best = total
                forward.append(best)
            last = word
            yield forward[-1] >> 40, forward[-1] & ((1 << 40) - 1)

    def learn(self) -> None:
        new = [w.encode() for w in islice(self.index, len(self.counts), None)]
        order = sorted(range(len(new)), key=new.__getitem__)
        counts = np.empty(len(new), dtype=np.int64)
        counts[order] = np.fromiter((n for _, n in self.walk([new[i] for i in order])), dtype=np.int64, count=len(new))
        self.counts = np.concatenate((self.counts, counts))

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.index) > MEMORY:
            self.forget()
        numbered = [np.fromiter(map(self.index.__getitem__, self.split(t)), dtype=np.int32) for t in texts]
        self.learn()
        return [(len(n), int(self.counts[n].sum())) for n in numbered]


_counters: dict[str, TrieCounter] = {}


def worker_counter(blob: bytes, pattern: str) -> TrieCounter:
    name = hashlib.sha256(blob + pattern.encode()).hexdigest()
    if name not in _counters:
        _counters.clear()
        _counters[name] = TrieCounter(zipf_scores(load_ranks(blob)), pattern)
    return _counters[name]


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens); no shuffle, the vocabulary (about 1 MB) is broadcast."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(vocabulary, "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(blob.value, pattern)
        for batch in gathered(batches):
            got = counter.count([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
