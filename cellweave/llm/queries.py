"""Queries over the driver's tables, one an operator, with DuckDB SQL where SQL can say the same.

The queries are thin: each reads its whole table, calls its operator with production parameters and
derives the columns to compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprint, linededup, mixing, neardup, substring, tokenstore, toxicity, unigram


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenstore.write_store(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=0)
    return tokenstore.read_store(spark, path)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), width=2, percent=80)


OP4_SQL = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents),
shingles as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
                                   else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s
    from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)),
linked as (select a, b from links union all select b, a from links),
reach(doc_id, root) as (select doc_id, doc_id from documents union select r.doc_id, t.b from reach r join linked t on r.root = t.a),
labelled as (select doc_id, min(root) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join labelled using (doc_id) left join sizes s on s.doc_id = d.doc_id
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(documents(spark, sf_dir), min_docs=10, min_chars=1))


OP5_SQL = r"""
with split as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i
    from documents),
keyed as (
    select doc_id, i, line,
           translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from split),
hot as (select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10)
select k.doc_id, count(*)::bigint as n_lines, count(h.key)::bigint as n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) order by k.i) filter (where h.key is null), '')) as kept_sha256
from keyed k left join hot h on k.key = h.key
group by k.doc_id
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), temperature=0.7, seed=17)
    return mixed.select("doc_id", "source", "lang", "text", F.col("__copies").alias("n_copies"), F.col("__copy").alias("copy"), F.col("__key").alias("shuffle_key"))


OP6_SQL = """
with recursive sizes as (select source, count(*)::double as size from documents group by source),
raws as (select source, size, pow(size, 0.7) as raw from sizes),
rates as (select source, raw / (select sum(raw) from raws) * (select sum(size) from raws) / size as rate from raws),
cdf as (
    select source, rate, 0 as k, exp(-rate) as p, exp(-rate) as cdf from rates
    union all
    select source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) from cdf
    where k < ceil(rate + 12 * sqrt(rate) + 20)),
drawn as (
    select d.*, cast('0x' || substr(md5('17|' || doc_id || '|' || md5(coalesce(text, ''))), 1, 13) as bigint) / 4503599627370496.0 as u
    from documents d),
counted as (
    select d.doc_id, any_value(d.source) as source, any_value(d.lang) as lang, any_value(d.text) as text,
           count(*) filter (where c.cdf <= d.u and c.k < ceil(c.rate + 12 * sqrt(c.rate) + 20))::int as n_copies
    from drawn d join cdf c on d.source is not distinct from c.source group by d.doc_id)
select doc_id, source, lang, text, n_copies, copy::int as copy,
       cast('0x' || substr(md5('18|' || doc_id || '|' || copy || '|' || n_copies), 1, 13) as bigint) / 4503599627370496.0 as shuffle_key
from (select *, unnest(range(1, n_copies + 1)) as copy from counted)
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup_substrings(documents(spark, sf_dir), width=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50),
windows as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from starts),
least as (select h, min(doc_id) as lo from windows group by h),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from windows join least using (h) where lo < doc_id),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words),
kept as (
    select e.doc_id, count(*) as n, count(g.p) as removed, string_agg(word, ' ' order by e.p) filter (where g.p is null) as kept
    from each e left join gone g on e.doc_id = g.doc_id and e.p = g.p group by e.doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_words, coalesce(removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join kept k using (doc_id)
"""


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_store": op2_token_store,
    "op3_token_counts": op3_token_counts,
    "op4_near_dedup": op4_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_nearest": op8_nearest,
    "op9_bpe": op9_bpe,
    "op10_fingerprints": op10_fingerprints,
}

SQL: dict[str, str] = {
    "op4_near_dedup": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
}
