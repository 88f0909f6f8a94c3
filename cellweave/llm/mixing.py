"""Mixing sources to target weights (operator 6): Poisson replication.

Each source has a target share of the output. Its mean repetition rate is share * target size / size
of the source, sizes counted in documents or code points. A hash of seed, document id and text gives
each document a uniform number; inverting the Poisson distribution with the source's rate at that
number gives its copies. The copies are exploded and dealt out by a hash of document and copy number:
a global shuffle that has the same result on any cluster.

Defined cases: a null source is a source of its own; null texts count no code points; a source with
no size has rate 1; repeated rows draw the same number and so the same copies; extra columns pass
through, and one with the name of an output column gives way to it; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Masked, partitions, stored

OUT = ("__copies", "__copy", "__key")
#: Rows of source rates that are broadcast (about 10 MB).
MAX_BROADCAST = 100_000
#: Up to this rate the running sum begins at no copies; beyond it, below all that counts in double precision.
FROM_ZERO = 500.0


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.7, target: float | None = None, by: str = "documents") -> DataFrame:
    """(__source, __rate), one row a source. Without weights, shares follow size ** temperature."""
    size = F.count(F.lit(1)).cast("double") if by == "documents" else F.sum(F.coalesce(F.char_length("text"), F.lit(0))).cast("double")
    sizes = docs.groupBy(F.col("source").alias("__source")).agg(size.alias("__size"))
    if weights is None:
        raw = F.pow("__size", F.lit(temperature))
    else:
        raw = F.lit(0.0)
        for name, weight in weights.items():
            raw = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(raw)
    sums = sizes.select(F.col("__source"), F.col("__size"), raw.alias("__raw"))
    total = sums.agg(F.sum("__raw").alias("__raws"), F.sum("__size").alias("__sizes"))  # one row
    wanted = F.lit(float(target)) if target is not None else F.col("__sizes")
    rate = F.when((F.col("__size") > 0) & (F.col("__raws") > 0), F.col("__raw") / F.col("__raws") * wanted / F.col("__size")).otherwise(F.lit(1.0))
    return sums.crossJoin(F.broadcast(total)).select("__source", rate.alias("__rate"))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 over seed and parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_inverse(rate: Column, u: Column) -> Column:
    """The smallest k with P(Poisson(rate) <= k) > u, by running sums of the probabilities.

    The sequence reaches beyond rate + 12 standard deviations, where the running sum has stopped
    growing in double precision. exp(-rate) vanishes for large rates, so beyond FROM_ZERO the sum begins
    12 standard deviations below the rate, at a probability worked out by its logarithm (Stirling's
    series); what lies below is less than 1e-30.
    """
    large = rate > F.lit(FROM_ZERO)
    low = F.when(large, F.floor(rate - 12 * F.sqrt(rate))).otherwise(F.lit(0)).cast("int")
    steps = F.sequence(low + 1, F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int"))
    gap = rate - low
    first = F.exp(F.when(large, low * F.log1p(gap / low) - gap - F.log(2 * math.pi * low) / 2 - 1 / (12 * low) + 1 / (360 * F.pow(low, F.lit(3.0)))).otherwise(-rate))
    # rate and u go along in the state, so that they are not worked out again in each step
    start = F.struct(first.alias("p"), first.alias("cdf"), low.alias("k"), rate.alias("rate"), u.alias("u"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * acc["rate"] / i
        k = acc["k"] + F.when(acc["cdf"] <= acc["u"], 1).otherwise(0)
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), k.alias("k"), acc["rate"].alias("rate"), acc["u"].alias("u"))

    return F.aggregate(steps, start, step)["k"]


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.7, target: float | None = None, by: str = "documents", seed: int = 17, out: tuple[str, str, str] = OUT) -> DataFrame:
    """docs with three columns named by ``out``: copies of the document, copy (from 1) and shuffle key; shuffled globally.

    The join side has a row a source. Its rows are counted: up to MAX_BROADCAST go to every task, so
    that no document moves for its rate; with more sources a join deals them out, and Spark splits
    the hot ones.
    """
    masked = Masked(docs, ("doc_id", "text", "source"), out)
    docs = masked.inner
    rates = stored(source_rates(docs, weights, temperature, target, by), "source-rates", narrow=True)
    rates = F.broadcast(rates) if rates.count() <= MAX_BROADCAST else rates
    drawn = docs.join(rates, F.col("source").eqNullSafe(F.col("__source")), "inner")
    drawn = drawn.withColumn("__copies", poisson_inverse(F.col("__rate"), uniform(seed, F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))))))
    copies = drawn.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    key = uniform(seed + 1, F.col("doc_id"), F.col("__copy"), F.col("__copies"))
    spark = docs.sparkSession
    dealt = copies.withColumn("__key", key).repartition(partitions(spark), "__key").sortWithinPartitions("__key")
    return masked.back(dealt, "__copies", "__copy", "__key")
