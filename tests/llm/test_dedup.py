"""Operators 4, 5 and 7 against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import linededup, neardup, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


# -- near duplicates


def slow_components(texts, width=2, percent=80):
    sets = {}
    for doc, text in texts.items():
        words = WORD.findall(text.translate(FOLD))
        n = min(width, len(words))
        sets[doc] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def near(df, width=2):
    return {r.doc_id: tuple(r)[1:] for r in neardup.near_duplicates(df, width, 80).collect()}


def test_near_odd_documents(docs, plain):
    assert near(docs) == slow_components(plain)


@pytest.mark.parametrize("width", [2, 5])
def test_near_corpus(corpus, corpus_texts, width):
    assert near(corpus, width) == slow_components(corpus_texts, width)


def test_near_large_group_with_heavier_and_lighter_edits(spark):
    """Chains of edits around one base: links near the threshold, and members that link with few."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = {}
    for i in range(260):
        words = list(base)
        for _ in range(rng.choice([0, 1, 3, 6, 9, 12])):
            words[rng.randrange(120)] = rng.choice(["of", "the", "and", f"x{rng.randrange(50)}"])
        texts[i] = " ".join(words)
    texts[1000] = texts[3]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert near(df) == slow_components(texts)


@pytest.mark.parametrize(("seed", "percent", "rounds"), [(5, 80, 0), (6, 80, 1), (7, 60, 0), (8, 100, 0)])
def test_near_settles_families_that_share_passages(spark, seed, percent, rounds):
    """Two families around bases of their own, members of both around a passage, and chains of edits: all that
    the leaders would link is left to the settling step, or most of it."""
    rng = random.Random(seed)
    bases = [[f"{k}{rng.randrange(900)}" for _ in range(n)] for k, n in (("a", 90), ("b", 110))]
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for i in range(420):
        words = list(rng.choice(bases))
        if i % 4 == 0:
            words = passage + words[: rng.choice([8, 20, 60])]
        for _ in range(rng.choice([0, 0, 1, 3, 5, 7, 9, 12, 20])):
            words[rng.randrange(len(words))] = rng.choice(["of", "the", f"x{rng.randrange(30)}", f"y{rng.randrange(9000)}"])
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in neardup.near_duplicates(df, 2, percent, rounds=rounds).collect()}
    want = slow_components(texts, 2, percent)
    if percent >= 80:
        assert got == want
    else:  # bands are set for 80 percent: below, a link may never be a candidate, but none is invented
        assert all(want[d][1] <= got[d][1] for d in texts)


def test_near_repeated_rows_count_once_a_class(spark):
    """Rows that repeat an id give one text and one set of shingles a class; other texts of the id stay apart."""
    rows = [(1, "a b c d")] * 3 + [(1, "p q r"), (2, "a b c e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = neardup.described(docs, 2, 14, 3).groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.min_by("t", "doc_id").alias("t"))
    texts = neardup.packed_texts(docs, classes.select("rep", "t"))
    members = texts.selectExpr("1L as bunch", "rep", "t", "packed", "cast(null as array<long>) as core")
    sets = neardup.member_edits(members, 2).collect()
    assert sorted((r.rep, r.n, len(r.edits)) for r in sets) == [(1, 2, 2), (1, 3, 3), (2, 3, 3)]


def test_near_empty_null_and_repeated_rows(spark, empty):
    assert near(empty) == {}
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        pool = rng.integers(0, 2**63, 110).astype(np.uint64)
        a, b = np.sort(pool[:100]), np.sort(np.concatenate((pool[11:100], pool[100:111])))  # 89 of 111: 0.80
        x, y = neardup.bands(a, neardup.TABLES, neardup.ROWS), neardup.bands(b, neardup.TABLES, neardup.ROWS)
        same = x == y
        missed += not (same[: neardup.TABLES].any() and same[neardup.TABLES :].any())
    assert missed <= 1


# -- lines


def slow_lines(texts, min_docs):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)

    df = Counter(k for t in texts.values() for k in {key(x) for x in t.split("\n")} if k)
    out = {}
    for doc, t in texts.items():
        lines = t.split("\n")
        kept = [x for x in lines if not df[key(x)] >= min_docs]
        out[doc] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("min_docs", [2, 10])
def test_lines(docs, plain, corpus, corpus_texts, min_docs):
    for df, texts in ((docs, plain), (corpus, corpus_texts)):
        got = {r.doc_id: tuple(r)[1:] for r in linededup.digest(linededup.dedup_lines(df, min_docs)).collect()}
        assert got == slow_lines(texts, min_docs)


def test_lines_join_path_is_the_same(corpus, corpus_texts):
    counts = linededup.stored(linededup.count_lines(corpus), "t")
    filters = linededup.build_filters(counts, 3, shard_keys=20)
    got = {r.doc_id: tuple(r)[1:] for r in linededup.digest(linededup.drop_lines(corpus, filters, limit=0)).collect()}
    assert got == slow_lines(corpus_texts, 3)


def test_lines_are_reversible(spark, corpus):
    """Insertion and deletion of documents bring the index back to where it was."""
    first, second = corpus.where("doc_id % 2 = 0"), corpus.where("doc_id % 2 = 1")
    counts = linededup.stored(linededup.count_lines(first), "t")
    filters = linededup.build_filters(counts, 3)
    more = linededup.stored(linededup.merge_counts(counts, linededup.count_lines(second)), "t")
    grown = linededup.update_filters(filters, counts, more, 3)
    back = linededup.stored(linededup.merge_counts(more, linededup.count_lines(second), -1), "t")
    shrunk = linededup.update_filters(grown, more, back, 3)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, counts.collect()))
    whole = {r.doc_id: tuple(r) for r in linededup.digest(linededup.drop_lines(corpus, grown)).collect()}
    assert whole == {r.doc_id: tuple(r) for r in linededup.digest(linededup.dedup_lines(corpus, 3)).collect()}
    half = {r.doc_id: tuple(r) for r in linededup.digest(linededup.drop_lines(first, shrunk)).collect()}
    assert half == {r.doc_id: tuple(r) for r in linededup.digest(linededup.dedup_lines(first, 3)).collect()}


def test_lines_min_chars_and_empty(spark, empty):
    df = spark.createDataFrame([(i, "é\nab\nlonger line") for i in range(3)], "doc_id long, text string")
    got = linededup.dedup_lines(df, 2, min_chars=2).select(linededup.OUT[2]).collect()
    assert {r[0] for r in got} == {"é"}
    assert linededup.digest(linededup.dedup_lines(empty, 2)).collect() == []


def test_lines_of_an_id_in_many_rows_are_one_document(spark):
    rows = [(1, "often\nonce")] * 12 + [(i, f"shared\nown {i}") for i in range(2, 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_dropped) for r in linededup.digest(linededup.dedup_lines(df, 10)).collect()}
    assert got == {(1, 0), *((i, 1) for i in range(2, 13))}


def test_lines_of_a_text_beyond_a_megabyte(spark):
    long = "\n".join(f"line {i % 70_000} of a long text" for i in range(100_000))
    texts = {i: f"common\n{long[: 1000 * i]}" for i in range(3)} | {5: long + "\ncommon"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert len(long) > 2_000_000
    assert {r.doc_id: tuple(r)[1:] for r in linededup.digest(linededup.dedup_lines(df, 3)).collect()} == slow_lines(texts, 3)


def test_near_splits_words_at_every_white_space(spark):
    texts = {1: "a\rb\x0cc\x0bd\te f", 2: "a b c d e f", 3: "a\x85b c\xa0d e f"}
    assert near(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == slow_components(texts)


def test_near_texts_beyond_a_megabyte(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(40_000)}" for _ in range(220_000)]
    texts = {1: " ".join(words), 2: " ".join(words[:-3000] + ["x"] * 3000), 3: " ".join(words[: len(words) // 2])}
    assert len(texts[1]) > 1_200_000
    assert near(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == slow_components(texts)


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63 - 1, (5000, 2))
    one = linededup.CuckooFilter(5000)
    one.insert(keys)
    one = linededup.CuckooFilter.from_bytes(one.to_bytes())
    assert one.contains(keys).all()
    one.delete(keys[:2500])
    assert one.contains(keys[2500:]).all() and one.contains(keys[:2500]).sum() < 5
    full = linededup.CuckooFilter(4)  # far too small: the rest goes to the stash
    full.insert(keys[:200])
    assert full.contains(keys[:200]).all() and linededup.CuckooFilter.from_bytes(full.to_bytes()).contains(keys[:200]).all()


# -- substrings


def slow_spans(texts, width):
    first, words = {}, {d: WORD.findall(t) for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), kept)
    return out


def substrings(df, width, **more):
    spans = substring.repeated_spans(df, width, **more)
    return {r.doc_id: tuple(r)[1:] for r in substring.remove_spans(df, spans).collect()}


def test_substrings_corpus(corpus, corpus_texts):
    assert substrings(corpus, 50) == slow_spans(corpus_texts, 50)


def test_substrings_odd_documents(docs, plain):
    assert substrings(docs, 4, anchor_words=2) == slow_spans(plain, 4)


@pytest.mark.parametrize("common", [1, 3, 1000])
def test_substrings_small_alphabet(spark, common):
    """Few words, so that passages repeat, overlap and extend each other in many ways."""
    rng = random.Random(common)
    passages = [[rng.choice("abcde") for _ in range(rng.randint(6, 25))] for _ in range(8)]
    texts = {}
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages)[rng.randrange(4) :] + [rng.choice("vwxyz") for _ in range(rng.randrange(4))]
        texts[i * 3] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert substrings(df, 8, anchor_words=3, common=common, shard_bytes=2000) == slow_spans(texts, 8)


def test_substrings_null_and_repeated_ids(spark, empty):
    assert substrings(empty, 5, anchor_words=2) == {}
    same = "a b c d e f g"
    rows = [(None, same), (None, same), (1, same), (1, same), (2, same), (3, None)]
    got = substring.remove_spans(df := spark.createDataFrame(rows, "doc_id long, text string"), substring.repeated_spans(df, 5, anchor_words=2)).collect()
    assert Counter((r.doc_id, r.n_removed) for r in got) == {(None, 0): 2, (1, 0): 2, (2, 7): 1, (3, 0): 1}


def test_suffix_automaton_knows_the_smallest_owner():
    rng = random.Random(9)
    docs = [[rng.randrange(3) for _ in range(rng.randint(1, 30))] for _ in range(25)]
    automaton = substring.SuffixAutomaton()
    for owner, words in enumerate(docs):
        automaton.add(words, owner)
    first = defaultdict(lambda: -1)
    for owner in reversed(range(25)):
        for i in range(len(docs[owner]) - 3):
            first[tuple(docs[owner][i : i + 4])] = owner
    for _ in range(40):
        query = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        assert automaton.window_owners(query, 4) == [first[tuple(query[i : i + 4])] for i in range(len(query) - 3)]


def test_digest_matches_sha(spark):
    df = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    kept = substring.dedup_substrings(df, 2).select(F.sha2("kept", 256).alias("h")).first()
    assert kept.h == hashlib.sha256(b"x y").hexdigest()
