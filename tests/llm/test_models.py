"""Operators 1, 6 and 8, and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellweave.llm import ann, fingerprint, linededup, mixing, neardup, queries, substring, toxicity

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

# -- toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    return docs, spark.read.parquet(f"{MEDIUM}/labels.parquet")


def test_toxicity_on_held_out_labels(labelled):
    docs, labels = labelled
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    score, y = got["score"].to_numpy(), got["toxic"].to_numpy()
    order = score.argsort().argsort()
    auc = (order[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    assert auc > 0.85 and (got["predicted"] == got["toxic"]).mean() > 0.9
    assert score.min() >= 0 and score.max() <= 1


def test_toxicity_never_learns_from_held_out_rows(labelled):
    docs, labels = labelled
    lies = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, lies)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_toxicity_held_out_rule(spark):
    got = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_toxicity_scores_are_sums_over_present_grams():
    rng = np.random.default_rng(0)
    weights = np.zeros(1 << toxicity.BITS, dtype=np.float32)
    weights[rng.integers(0, len(weights), 300_000)] = 0.01
    model = toxicity.Model(-1.0, weights)
    texts = [b"", b"abc", "Déjà VU and more words".encode(), b"x" * 5000, bytes(rng.integers(97, 123, 3_000_000, dtype=np.uint8))]
    for got, raw in zip(model.scores(texts), texts, strict=True):
        want = -1.0 + float(weights[toxicity.features(raw)].astype(np.float64).sum()) if raw else -1.0
        assert got == pytest.approx(1 / (1 + math.exp(-max(-500, min(500, want)))), rel=1e-4)


def test_toxicity_without_labels_or_classes(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert all(r.score < 0.5 for r in toxicity.toxicity(docs, one).collect())
    assert toxicity.toxicity(empty, one).collect() == []


def test_toxicity_odd_documents(spark, docs, labelled):
    texts = docs.select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text").unionByName(labelled[0].select("doc_id", "text"))
    got = toxicity.toxicity(texts, labelled[1]).where("doc_id >= 10000000").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id - 10_000_000: r.score for r in got}
    assert scores[0] == scores[1] and scores[3] == scores[4]


def test_toxicity_keeps_more_than_2048_strong_features():
    """Three thousand equally strong features: a text whose toxic wording is the last of them counts."""
    shared = np.arange(3000, dtype=np.uint32)
    rows = [(y, np.unique(np.concatenate([shared if y else shared + 5000, [20_000 + i]])).astype(np.uint32)) for i, y in enumerate([0, 1] * 200)]
    model = toxicity.fit(rows, 0.5)
    assert np.count_nonzero(model.weights[:3000]) + np.count_nonzero(model.weights[5000:8000]) == 4096
    assert np.count_nonzero(toxicity.fit(rows, 0.5, max_features=6000).weights) == 6000


def test_toxicity_fit_is_the_same_in_any_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(y, np.flatnonzero(rng.random(2000) < (0.1 + 0.3 * y * (np.arange(2000) < 900))).astype(np.uint32)) for y in [0, 1] * 100]
    whole = toxicity.fit(rows, 0.5)
    monkeypatch.setattr(toxicity, "FIT_BLOCK", 500)
    parts = toxicity.fit(rows, 0.5)
    assert parts.bias == pytest.approx(whole.bias, abs=1e-9) and np.allclose(parts.weights, whole.weights, atol=1e-6) and whole.weights.any()


def test_toxicity_grams_are_of_characters():
    """A gram is of code points: letters of one, two, three or four bytes count alike."""
    assert [len(toxicity.features(t.encode())) for t in ("abcd", "éèêë", "中文字符", "😀😁😂🤣", "abc")] == [1, 1, 1, 1, 0]
    assert (toxicity.features("ÄBCDE".encode()) == toxicity.features("Äbcde".encode())).all()
    assert (toxicity.features(b"ABCDE") == toxicity.features(b"abcde")).all()


# -- columns that clash with work columns or need quotes

AWKWARD = ["__toxic", "__n_lines", "__n_dropped", "__kept", "__copies", "__copy", "__key", "__source", "__rate", "__place", "__hash", "__drops", "x0", "n", "a.b", "tick`s", "label"]


@pytest.fixture(scope="module")
def awkward(spark, docs):
    return docs.select("*", *[F.lit(i).alias(name) for i, name in enumerate(AWKWARD)])


def test_stages_keep_awkward_columns(spark, awkward):
    repeated = awkward.unionByName(awkward.where("doc_id = 3"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, repeated, SMALL)
        assert after.columns == awkward.columns, name
        rows = after.collect()
        assert rows and all(tuple(r)[-len(AWKWARD) :] == tuple(range(len(AWKWARD))) for r in rows), name
        if name == "MinHash near-dedup":
            assert [r.doc_id for r in rows if r.doc_id in (3, 4)] == [3]
    assert corpus_pipeline.STAGES[-1][1](spark, repeated, SMALL).count() == repeated.count()


def test_operators_replace_columns_of_their_output_names(awkward):
    model = toxicity.Model(0.0, np.zeros(1 << toxicity.BITS, dtype=np.float32))
    for got, out in (
        (toxicity.score_documents(awkward, model), ("__toxic",)),
        (linededup.dedup_lines(awkward), linededup.OUT),
        (mixing.mix(awkward), mixing.OUT),
    ):
        assert got.columns == [c for c in awkward.columns if c not in out] + list(out)
        assert got.where(F.col("`a.b`") == AWKWARD.index("a.b")).count() == got.count() > 0


def test_other_operators_ignore_awkward_columns(docs, awkward):
    for operator in (neardup.near_duplicates, substring.dedup_substrings, fingerprint.fingerprints):
        assert sorted(map(str, operator(awkward).collect())) == sorted(map(str, operator(docs).collect()))


# -- mixing


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    cdf = p
    while cdf <= u and k < 1000:
        k += 1
        p *= rate / k
        cdf += p
    return k


def test_mixing_inverts_poisson(spark):
    rows = [(r, u) for r in (0.01, 0.5, 1.0, 3.7, 40.0, 300.0) for u in (0.0, 0.1, 0.36, 0.5, 0.9, 0.999, 0.9999999)]
    got = spark.createDataFrame(rows, "r double, u double").select("r", "u", mixing.poisson_inverse(F.col("r"), F.col("u")).alias("k")).collect()
    assert [x.k for x in got] == [poisson(x.r, x.u) for x in got]


def test_mixing_matches_plain_python(docs):
    rows = docs.collect()
    sizes = Counter(r.source for r in rows)
    raws = {s: n**0.7 for s, n in sizes.items()}
    want = Counter()
    for r in rows:
        rate = raws[r.source] / sum(raws.values()) * len(rows) / sizes[r.source]
        u = int(hashlib.md5(f"17|{r.doc_id}|{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
        want[r.doc_id] += poisson(rate, u)
    got = mixing.mix(docs)
    assert Counter(r.doc_id for r in got.collect()) == +want
    assert got.columns[: len(docs.columns)] == docs.columns


def test_mixing_reaches_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 7000, "a").when(F.col("id") < 19_000, "b").alias("source"))
    got = {r["source"]: r["n"] for r in mixing.mix(df, {"a": 0.5, "b": 0.3, None: 0.2}, target=30_000).groupBy("source").agg(F.count("*").alias("n")).collect()}
    for source, share in {"a": 15_000, "b": 9_000, None: 6_000}.items():
        assert abs(got[source] - share) < 5 * math.sqrt(share)


def test_mixing_inverts_rates_beyond_500(spark):
    def exact(rate, u):  # by logarithms of all probabilities from 0
        k, cdf = -1, 0.0
        while cdf <= u:
            k += 1
            cdf += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        return k

    rows = [(r, u) for r in (500.5, 800.0, 5000.0, 40_000.0) for u in (0.001, 0.1, 0.36, 0.5, 0.9, 0.999)]
    got = spark.createDataFrame(rows, "r double, u double").select("r", "u", mixing.poisson_inverse(F.col("r"), F.col("u")).alias("k")).collect()
    assert [x.k for x in got] == [exact(x.r, x.u) for x in got]


def test_mixing_reaches_weights_of_a_small_source(spark):
    df = spark.range(1100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 20, "small").otherwise("large").alias("source"))
    got = {r["source"]: r["n"] for r in mixing.mix(df, {"small": 0.9, "large": 0.1}, target=50_000).groupBy("source").agg(F.count("*").alias("n")).collect()}
    for source, share in {"small": 45_000, "large": 5_000}.items():
        assert abs(got[source] - share) < 5 * math.sqrt(share)


def test_mixing_joins_many_sources(docs, monkeypatch):
    want = sorted(r.doc_id for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert sorted(r.doc_id for r in mixing.mix(docs).collect()) == want


def test_mixing_empty(empty):
    assert mixing.mix(empty).collect() == []


# -- nearest neighbours


def test_search_recall_and_exact_scores(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got, want = {}, ann.exact(table)
    for r in ann.search(table).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in table.collect()}
    for q, found in got.items():
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert [s for _, (_, s) in sorted(found.items())] == sorted((s for _, s in found.values()), reverse=True)
        for v, s in found.values():
            a, b = vectors[q], vectors[v]
            assert s == pytest.approx(a @ b / math.sqrt((a @ a) * (b @ b)), abs=1e-14)


def test_search_probes_few_of_many_parts_where_vectors_cluster(spark):
    """Parts follow the table's size; where vectors lie in groups, few parts need to be looked at."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 24))
    vectors = centres[rng.integers(0, 60, 4000)] + 0.15 * rng.normal(size=(4000, 24))
    router = ann.learn(vectors, parts=40)
    assert len(router.b2) == 40 and router.probes <= 10
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    want, hits = ann.exact(table), 0
    for r in ann.search(table, rows_a_part=100).collect():
        hits += r.vec_id in {v for v, _ in want[r.query_id]}
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_search_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (50, [0.0, 2.0], 1), (1, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (100, [float("inf"), 0.0], 1), (8, [-1.0, 1e-9], 1)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), k=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 8), (50, 1, 8), (50, 2, 0), (50, 3, 1), (50, 4, 2)]


def test_search_ties_among_many_copies(spark):
    """A third of all rows are one vector; the smallest ids win."""
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(900)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, 900, 150):
        ids = [i for i in range(0, 900, 3) if i != q][:5]
        assert [v for _, v in sorted(found[q])] == ids


def test_search_empty(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []
    assert ann.search(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")).collect() == []


# -- pipeline


def test_pipeline_stages(spark):
    docs = queries.documents(spark, SMALL)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "MinHash near-dedup", "mixing", "byte-level BPE"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
        after = stage(spark, docs, SMALL)
        if name == "byte-level BPE":
            assert {r.doc_id for r in after.collect()} == set(before)
            break
        assert after.columns == columns
        rows = after.collect()
        if name == "line dedup":
            assert {r.doc_id for r in rows} == set(before) and all(r.n_chars == len(r.text) for r in rows)
        if name == "MinHash near-dedup":
            kept = {r.doc_id for r in neardup.near_duplicates(docs, 5, 80).where("kept").collect()}
            assert {r.doc_id for r in rows} == kept
        docs = spark.createDataFrame(rows, after.schema)


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 50


def test_pipeline_drops_toxic_and_keeps_clean(spark):
    docs = queries.documents(spark, MEDIUM)
    left = corpus_pipeline.drop_toxic(spark, docs, MEDIUM)
    insults = F.lower("text").rlike("trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron")
    assert left.where(insults).count() < 0.2 * docs.where(insults).count()
    assert left.count() > 0.85 * docs.count()
