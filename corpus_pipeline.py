"""A training-corpus pipeline: five stages over documents, each an operator of cellweave.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. SQL cannot express the classifier or the tokeniser, so there is no oracle; tests compare
every stage with plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm import bpe, linededup, mixing, neardup, queries, toxicity
from cellweave.llm.common import free_names, quoted, repeated_ids, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; the classifier learns from labelled rows."""
    model = toxicity.train(docs, queries.labels(spark, sf_dir))
    (score,) = free_names(docs, "__toxic")
    return toxicity.score_documents(docs, model, score).where(F.col(score) < 0.5).drop(score)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every text; documents stay, n_chars follows."""
    out = free_names(docs, *linededup.OUT)
    new = {"text": F.col(out[2])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(out[2]).cast(docs.schema["n_chars"].dataType)
    rewritten = linededup.dedup_lines(docs, min_docs=10, out=tuple(out))
    return rewritten.select(*[new.get(c, quoted(c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar five-word shingles the one with the smallest id stays.

    Rows that repeat an id are one document: of those that stay, one row does. Rows without id all stay.
    """
    columns = [quoted(c) for c in docs.columns]
    gone = neardup.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*columns)
    again = repeated_ids(docs)
    if again is None:
        return kept
    rows = kept.join(again, "doc_id", "left_semi").select(*columns)
    place, text = free_names(docs, "__place", "__hash")
    first = Window.partitionBy("doc_id").orderBy(text)
    rows = rows.withColumn(text, F.xxhash64("text")).withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return kept.join(again, "doc_id", "left_anti").select(*columns).unionByName(rows.select(*columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat (or drop out) by their source's rate, in a globally shuffled order."""
    out = free_names(docs, *mixing.OUT)
    return mixing.mix(docs, temperature=0.7, seed=17, out=tuple(out)).drop(*out)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, one row a document copy."""
    return bpe.encode_documents(docs, queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
