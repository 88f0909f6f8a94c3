"""Operators 2, 3 and 9 against the libraries and plain Python."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

from cellweave.llm import bpe, tokenstore, unigram

RANK_FILE = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(RANK_FILE, "rb") as f:
        return bpe.load_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    alphabet = "abcdefgh aeiou\n\t  .,'’éÀ😀中\x1c\x85\xa0 　²½ٓ"
    return ["", "a" * 3000, "ab" * 3000, "abcab" * 777, " \n \n\n x", "don't I'll we've"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(200)]


def test_bpe_encodes_like_the_library(ranks, reference):
    enc = bpe.Encoder(ranks, P.PATTERN)
    for text, ids in zip(odd_texts(), enc.encode(odd_texts()), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert enc.decode(ids.tolist()) == text.encode()


def test_bpe_single_pair_path(ranks, reference):
    enc = bpe.Encoder(ranks, P.PATTERN)
    for text in odd_texts()[1:60]:
        for word in regex.findall(P.PATTERN, text)[:4]:
            if word.encode() not in ranks:
                assert bpe.encode_one(enc.table, word.encode()).tolist() == reference.encode_ordinary(word)


def test_bpe_lower_rank_after_a_merge_is_exact():
    """A made-up vocabulary where merging rank 11 brings up rank 10 in the same piece."""
    vocabulary = {bytes([b]): b for b in range(256)} | {b"cdab": 256, b"ab": 257, b"cd": 258, b"bcd": 259}
    table = bpe.MergeTable(vocabulary)
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    library = tiktoken.Encoding("x", pat_str=r"(?s).+", mergeable_ranks=vocabulary, special_tokens={})
    ids, offsets = bpe.encode_pieces(table, pieces, [vocabulary.get(p) for p in pieces])
    for i, piece in enumerate(pieces):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode_ordinary(piece.decode())


def test_rank_queue_pops_in_order():
    queue, rng = bpe.RankQueue(50_000), np.random.default_rng(1)
    ranks = rng.integers(0, 50_000, 3000).astype(np.int32)
    queue.push_all(ranks, np.arange(3000, dtype=np.int32))
    popped = []
    while (got := queue.pop()) is not None:
        popped.append(got[0])
        assert sorted(np.concatenate(got[1]).tolist()) == np.flatnonzero(ranks == got[0]).tolist()
    assert popped == sorted(set(ranks.tolist()))


def bpe_digest(reference, text):
    ids = reference.encode_ordinary(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("table", ["docs", "corpus"])
def test_bpe_query(request, table, reference):
    df = request.getfixturevalue(table)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    got = {r.doc_id: tuple(r)[1:] for r in bpe.encode_documents(df, RANK_FILE, P.PATTERN).collect()}
    assert got == {i: bpe_digest(reference, t) for i, t in texts.items()}


def test_bpe_empty_table(empty):
    assert bpe.encode_documents(empty, RANK_FILE, P.PATTERN).collect() == []


def test_elias_fano_selects():
    rng = np.random.default_rng(2)
    for n, gap in ((1, 5), (2, 1), (700, 1), (5000, 900), (300, 100_000)):
        values = np.cumsum(rng.integers(0, gap, n))
        one = tokenstore.EliasFano.from_bytes(tokenstore.EliasFano.build(values).to_bytes())
        assert one.values().tolist() == values.tolist()
        assert [one.select(i) for i in range(n)] == values.tolist()
    assert len(one.to_bytes()) * 8 < 300 * 24


def test_shard_round_trip():
    documents = [np.array(x, dtype=np.int32) for x in ([1, 2, 0], [0], [70_000, 5, 0])]
    shard = tokenstore.Shard.unpack(tokenstore.Shard.pack(documents))
    assert [shard.document(i).tolist() for i in range(3)] == [d.tolist() for d in documents]


@pytest.mark.parametrize("table", ["docs", "corpus"])
def test_token_store(spark, request, table, tmp_path):
    df = request.getfixturevalue(table)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, start = {}, 0
    for doc in sorted(texts):
        ids = [*library.encode(texts[doc], add_special_tokens=False).ids, 0]
        want[doc] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    path = tokenstore.write_store(df, P.path("byte_bpe_50k.json"), path=str(tmp_path / "store"), shard_ids=5000)
    assert {r.doc_id: tuple(r)[1:] for r in tokenstore.read_store(spark, path).collect()} == want


def test_token_store_chunks_like_the_library():
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        enc = tokenstore.ChunkEncoder(f.read())
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    mark = next(iter(library.get_added_tokens_decoder().values())).content
    texts = [t for t in odd_texts() if t] + [mark, f"hi {mark} there", f"{mark}{mark}\n a{mark}b", mark[:-1] + " >"]
    assert enc.byte_level
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_store_takes_other_tokenizer_files(spark, tmp_path):
    """A file that is not byte-level is left to the library text by text."""
    model = models.WordLevel({"[UNK]": 0, "a": 1, "b": 2, ".": 3, "[MARK]": 4}, unk_token="[UNK]")
    other = Tokenizer(model)
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.add_special_tokens(["[MARK]"])
    other.save(str(tmp_path / "words.json"))
    texts = ["a b.", "b.a", "", "a [MARK]b zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = tokenstore.write_store(df, str(tmp_path / "words.json"), end_id=9, path=str(tmp_path / "store"))
    want = [[*other.encode(t, add_special_tokens=False).ids, 9] for t in texts]
    assert [r.ids_crc32 for r in sorted(tokenstore.read_store(spark, path).collect(), key=lambda r: r.doc_id)] == [zlib.crc32(np.array(w, dtype="<u4").tobytes()) for w in want]


def test_token_store_empty_and_null_ids(spark, empty, tmp_path):
    path = tokenstore.write_store(empty, P.path("byte_bpe_50k.json"), path=str(tmp_path / "none"))
    assert tokenstore.read_store(spark, path).collect() == []
    odd = spark.createDataFrame([(None, "a"), (1, None), (1, "b")], "doc_id long, text string")
    path = tokenstore.write_store(odd, P.path("byte_bpe_50k.json"), path=str(tmp_path / "odd"))
    got = sorted(tokenstore.read_store(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1] and sum(r.n_tokens for r in got) == 5


def viterbi(costs, word):
    best = [(0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for begin in range(end):
            cost = costs.get(word[begin:end])
            if cost is not None and best[begin] is not None:
                total = (best[begin][0] + cost, best[begin][1] + 1)
                if best[end] is None or total < best[end]:
                    best[end] = total
    return best[-1]


@pytest.mark.parametrize("table", ["docs", "corpus"])
def test_token_counts(request, table, ranks):
    df = request.getfixturevalue(table)
    texts = {r.doc_id: (r.text or "")[:3000] for r in df.collect()}
    short = df.sparkSession.createDataFrame(list(texts.items()), "doc_id long, text string")
    costs, memory = unigram.zipf_scores(ranks), {}

    def tokens(word):
        if word not in memory:
            memory[word] = viterbi(costs, word.encode())[1] if len(word) < 60 else None
        return memory[word]

    for r in unigram.count_tokens(short, RANK_FILE, P.PATTERN).collect():
        words = regex.findall(P.PATTERN, texts[r.doc_id])
        assert r.n_pretokens == len(words)
        if all(tokens(w) is not None for w in words):
            assert r.n_tokens == sum(map(tokens, words))


def test_token_counts_share_prefixes(ranks):
    counter = unigram.TrieCounter(unigram.zipf_scores(ranks), P.PATTERN)
    words = sorted({w.encode() for w in ["a", "ab", "abc", "abd", "b", "thanon", "thanonion", "than", "zzzzzzzzzz" * 9]})
    assert [n for _, n in counter.walk(words)] == [viterbi(unigram.zipf_scores(ranks), w)[1] for w in words]


def test_token_counts_empty(empty):
    assert unigram.count_tokens(empty, RANK_FILE, P.PATTERN).collect() == []
