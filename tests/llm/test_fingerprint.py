"""Operator 10 against plain Python."""

import hashlib

import numpy as np
import pytest

from cellweave.llm import fingerprint as fp
from cellweave.llm.common import mix64, window_hashes, word_hashes

M = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def slow_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def slow_hash(values):
    return slow_mix(sum(v * pow(BASE, i, 1 << 64) for i, v in enumerate(values)) & M)


def slow_sketch(text, fraction=fp.FRACTION, width=fp.WIDTH):
    words = [slow_hash([b + 1 for b in w]) for w in text.encode().lower().split()] if text else []
    width = min(width, len(words))
    hashes = {slow_hash(words[i : i + width]) >> 16 for i in range(len(words) - width + 1)} if words else set()
    return {h for h in hashes if h < int(fraction * (1 << 48))} or set(sorted(hashes)[:1])


def near(a, b):
    return len(a & b) / min(len(a), len(b)) if a and b else float(not a and not b)


def check(df):
    texts = sorted((r.doc_id, r.text or "") for r in df.collect())
    got = {r.doc_id: r for r in fp.fingerprints(df).collect()}
    assert sorted(got) == [i for i, _ in texts]
    for (doc, text), (_, following) in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r, mine, other, nxt = got[doc], slow_sketch(text), slow_sketch(changed), slow_sketch(following)
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert set(fp.from_text(r.fingerprint).tolist()) == mine
        assert set(fp.from_text(r.edited_fingerprint).tolist()) == other
        assert r.near_edited == pytest.approx(near(mine, other)) and r.near_next == pytest.approx(near(mine, nxt))


def test_odd_documents(docs):
    check(docs)


def test_corpus(corpus):
    check(corpus.limit(80))


def test_single_and_empty(spark, empty):
    check(spark.createDataFrame([(7, "a b c")], "doc_id long, text string"))
    assert fp.fingerprints(empty).collect() == []


def test_null_and_repeated_ids(spark):
    rows = [(None, "n one"), (None, "n two"), (1, "b"), (1, "a"), (2, "c")]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0)] * 2 + [(True, 1)] * 2 + [(True, 2)]


def test_merge_is_the_sketch_of_the_union():
    a, b = b"a b c d e f g h i j k l m", b"q w e r t y u i o p a s d f g"
    both = np.union1d(fp.sketch(a, 1.0), fp.sketch(b, 1.0))
    kept = both[both < np.uint64(int(fp.FRACTION * (1 << 48)))]
    assert fp.merge(fp.sketch(a), fp.sketch(b)).tolist() == kept.tolist()


def test_vectorised_hashes_match_the_formula():
    raw = b"  one two\tthree " + b"four" * 10
    _, _, words = word_hashes(raw)
    assert words.tolist() == [slow_hash([b + 1 for b in w]) for w in raw.split()]
    assert window_hashes(words, 2).tolist() == [slow_hash(words.tolist()[i : i + 2]) for i in range(len(words) - 1)]
    assert mix64(np.array([5], dtype=np.uint64)).tolist() == [slow_mix(5)]
