"""Formulas over Structured Streaming frames.

Row formulas run on a stream as they do on a table. Reductions run over event-time windows, late
rows up to the watermark included; formulas that need a table's order or another stream do not.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..formula.nodes import Call
from ..formula.parser import parse
from ..plans import aggregates as A
from ..plans import columns as C
from ..plans.book import Book
from ..plans.columns import Unsupported
from ..plans.rows import Rows


def column_stream(stream: DataFrame, formulas: Mapping[str, str], keep: Iterable[str] = (), lookups: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Row formulas over a stream; lookups names static tables for XLOOKUP and its kin."""
    book = Book(stream.sparkSession).table("stream", stream)
    for name, df in (lookups or {}).items():
        book.table(name, df, df.columns[:1])
    return book.select("stream", formulas, keep)


def windowed(stream: DataFrame, time: str, length: str, formulas: Mapping[str, str], by: Iterable[str] = (), slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Reductions such as =SUMIFS(stream[value],stream[kind],"view") a window (and a key).

    One state store entry a window and key; partial aggregates combine before the shuffle.
    """
    book = Book(stream.sparkSession).table("stream", stream)
    rows = Rows(book, "stream")
    aggs, finishes = [], {}
    for name, formula in formulas.items():
        node = parse(formula)
        if not isinstance(node, Call) or not A.is_reduction(node):
            raise Unsupported("a window needs a reduction over the stream's columns")
        plan = A.reduce_(book, rows, node.name, node.args, {})
        if plan.one_row is not None:
            raise Unsupported(f"{node.name} needs more than one pass")
        names = [f"__{name}_{i}" for i in range(len(plan.aggs))]
        aggs += [a.alias(n) for a, n in zip(plan.aggs, names, strict=True)]
        finishes[name] = (plan, names)
    by = list(by)
    if stream.schema[time].dataType.typeName() != "timestamp":
        stream = stream.withColumn(time, F.col(f"`{time}`").cast("timestamp"))
    window = F.window(time, length, slide) if slide else F.window(time, length)
    grouped = stream.withWatermark(time, watermark).groupBy(window.alias("window"), *[F.col(f"`{b}`") for b in by]).agg(*aggs)
    out = []
    for name, (plan, names) in finishes.items():
        x = plan.finish([F.col(n) for n in names])
        out.append(C.guard(x.col, x.err).alias(name))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[F.col(f"`{b}`") for b in by], *out)
