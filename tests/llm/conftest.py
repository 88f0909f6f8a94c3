import pytest

ODD = [
    (0, None),
    (1, ""),
    (2, " \n\t"),
    (3, "one two three four five six seven"),
    (4, "one two three four five six seven"),
    (5, "Déjà vu 中文 😀 don't stop\x85now\xa0ok"),
    (6, "x" * 30000),
    (7, "word " * 5000),
    (8, "A\nb \n  a\n\nB"),
    (9, "short"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, repeated texts; an extra column with a clashing name."""
    rows = [(i, t, "s", "score") for i, t in ODD] + [(20 + i, f"line {i}\nShared Line\n tail {i % 3}", None if i % 2 else "t", "x") for i in range(24)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, score string")


@pytest.fixture(scope="session")
def plain(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def corpus_texts(corpus):
    return {r.doc_id: r.text or "" for r in corpus.collect()}
