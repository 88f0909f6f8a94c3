"""Order-dependent operators that keep no total order in one task.

A table's order is cut into ranges of the key by approximate quantiles; ranges are sorted on their
own, and small per-range totals, combined over a table with a row a range, carry results from range
to range. Rows that agree in the keys that cut the order stay in one range, the others break ties inside it.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Key = tuple[str, bool]  # column and ascending


def keys_of(order: list[Key]) -> list[Column]:
    return [F.col(f"`{c}`").asc_nulls_first() if up else F.col(f"`{c}`").desc_nulls_last() for c, up in order]


def chunk(c: Column, at: int) -> Column:
    """Six bytes of a text from a place on, as a number that sorts like them."""
    return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), at + 1, 6)), 12, "0"), 16, 10).cast("double")


def number(c: Column, kind: str) -> Column:
    if kind == "date":
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return chunk(c, 0) if kind in ("string", "binary") else c.cast("double")


def digits(df: DataFrame, order: list[Key], wanted: list[float]) -> tuple[list[tuple[Column, bool, str]], list[float] | None]:
    """Numbers that sort as the keys do, one after the other, each with its direction and key; and the first one's
    quantiles, if the pass that looks at texts could tell them already.

    A text gives the six bytes after the prefix that all texts share, then the next six, and so on.
    Where rows that agree in a number might still differ in its key, no further numbers follow.
    """
    kinds = {name: df.schema[name].dataType.typeName() for name, _ in order[:3]}
    texts = [name for name, kind in kinds.items() if kind in ("string", "binary")]
    facts, cuts, out = {}, None, []
    if texts:
        looks = {"lo": F.min, "hi": F.max, "n": lambda c: F.max(F.length(c)), "null": lambda c: F.max(c.isNull())}
        asked = [f(F.col(f"`{t}`").cast("binary")).alias(f"{k}{i}") for i, t in enumerate(texts) for k, f in looks.items()]
        head = order[0][0]
        row = df.agg(*asked, F.percentile_approx(number(F.col(f"`{head}`"), kinds[head]), wanted, 10000).alias("q")).first()
        cuts = row["q"]
        for i, t in enumerate(texts):
            lo, hi, n = bytes(row[f"lo{i}"] or b""), bytes(row[f"hi{i}"] or b""), row[f"n{i}"] or 0
            if lo != hi or row[f"null{i}"]:
                facts[t] = (len(os.path.commonprefix([lo, hi])), n)
        if head in texts and facts.get(head, (1,))[0]:
            cuts = None  # these were of another place in the text
    for name, up in order[:3]:
        c = F.col(f"`{name}`")
        if name in texts and name not in facts:
            continue  # one value in all rows
        if name in facts:
            start, length = facts[name]
            out += [(chunk(c, at), up, name) for at in range(start, max(min(length, start + 24), start + 1), 6)]
            if length > start + 24:
                break
        else:
            out.append((number(c, kinds[name]), up, name))
            if kinds[name] == "decimal":
                break
    return out, cuts


class Cut(NamedTuple):
    """Ranges of an order."""

    place: Column  # the range of a row, growing along the order
    every: list[int]  # all ranges there are
    split: bool  # rows that agree in the first key may be in several ranges
    even: bool  # no rows that agree in all keys fill several ranges


def upto(bounds: list[float], value: Column) -> Column:
    """How many of the sorted bounds are not above a value, by halving."""
    held = F.array(*[F.lit(float(b)) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= value, at + step).otherwise(at))


def cutter(df: DataFrame, order: list[Key], n: int | None = None) -> Cut:
    """Ranges for the rows of df (or of any frame with its keys).

    Bounds are approximate quantiles of the first key. A value that fills several of its ranges (a
    status, a segment) is cut further by what follows it in the order, as many ranges as it fills.
    """
    spark = df.sparkSession
    n = n or max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    wanted = [i / n for i in range(1, n)]
    parts, got = digits(df, order, wanted)
    if not parts:
        return Cut(F.lit(0).cast("long"), [0], False, False)
    cols = [f"d{i}" for i in range(len(parts))]
    numbers = df.select(*[c.alias(d) for d, (c, *_) in zip(cols, parts, strict=True)])
    if got is None:
        got = numbers.select(F.percentile_approx("d0", wanted, 10000)).first()[0] or []
    cuts = {(): sorted(got)}  # of each path of heavy values so far
    place, width, levels = F.lit(0).cast("long"), n + 2, []

    def on(path: tuple, columns: list[Column]) -> Column:
        same = F.lit(True)
        for c, v in zip(columns, path, strict=False):
            same = same & (c == F.lit(v))
        return same

    def beyond(level: int) -> int:
        return width - 1 if level and parts[level - 1][1] else 0

    for level, (value, up, _) in enumerate(parts[:3]):
        levels.append({path: sorted(set(found)) for path, found in cuts.items()})
        # a row that shares a range with a heavy value without having it lies beyond that value
        here = F.lit(beyond(level))
        for path, found in cuts.items():
            mine = F.when(value.isNull(), F.lit(0)).otherwise(upto(sorted(set(found)), value) + 1) if found else F.lit(0)
            here = F.when(on(path, [c for c, *_ in parts]), mine if up else width - 1 - mine).otherwise(here)
        place = place * width + here
        # integers beyond 2^53 may differ where their doubles agree
        heavy = {(*path, v): k for path, found in cuts.items() for v, k in Counter(found).items() if k > 1 and abs(v) < 2**53}
        if not heavy or level + 1 == min(len(parts), 3):
            break
        match = F.lit(False)
        for path in heavy:
            match = match | on(path, [F.col(c) for c in cols])
        rows = numbers.where(match).groupBy(*cols[: level + 1]).agg(F.percentile_approx(cols[level + 1], wanted, 10000).alias("q")).collect()  # at most n rows
        cuts = {}
        for r in rows:
            path = tuple(r[c] for c in cols[: level + 1])
            k = heavy[path] + 1
            cuts[path] = [r["q"][i * n // k - 1] for i in range(1, k)] if r["q"] and k <= n else r["q"] or []
    def every(level: int, path: tuple | None) -> set[int]:
        if level == len(levels):
            return {0}
        found = levels[level].get(path) if path is not None else None
        unit, other, out = width ** (len(levels) - 1 - level), every(level + 1, None), set()
        if found is None:
            return {beyond(level) * unit + r for r in other}
        for j in range(len(found) + 2):
            here = j if parts[level][1] else width - 1 - j
            out |= {here * unit + r for r in (other | every(level + 1, (*path, found[j - 2])) if j > 1 else other)}
        return out

    return Cut(place, sorted(every(0, ())), len(levels) > 1 or parts[0][2] != order[0][0], not heavy)


def ranges(df: DataFrame, order: list[Key], n: int | None = None) -> DataFrame:
    """df with __range, growing along the order."""
    return df.withColumn("__range", cutter(df, order, n).place)


def carried(ranged: DataFrame, totals: list[Column], names: list[str]) -> DataFrame:
    """(__range, names...): sums of all ranges before, from a table with a row a range."""
    per = ranged.groupBy("__range").agg(*[t.alias(n) for t, n in zip(totals, names, strict=True)])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # few rows
    return per.select("__range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names])


def with_ordinal(df: DataFrame, order: list[Key], name: str = "__row") -> DataFrame:
    """df with the row's number along the order, from 1."""
    ranged = ranges(df, order)
    starts = carried(ranged, [F.count(F.lit(1))], ["__before"])
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*keys_of(order)))
    return ranged.join(F.broadcast(starts), "__range").withColumn(name, local + F.col("__before")).drop("__range", "__before")


class Places:
    """Values at places of a column's sorted values.

    Counts of ranges tell which range holds a place; only that range's distinct values are counted
    and ordered. No sort or map of all values; ranges and their counts serve all questions.
    """

    def __init__(self, df: DataFrame, name: str):
        self.name = name
        self.ranged = ranges(df.where(F.col(f"`{name}`").isNotNull()).select(F.col(f"`{name}`")), [(name, True)])
        self.sizes = sorted((r["__range"], r["n"]) for r in self.ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a range
        self.total = sum(n for _, n in self.sizes)

    def at(self, wanted: Iterable[int]) -> dict[int, float]:
        """The values at the wanted places, from 0."""
        places = {}
        for place in set(wanted):
            before = 0
            for r, n in self.sizes:
                if place < before + n:
                    places[place] = (r, place - before)
                    break
                before += n
        if not places:
            return {}
        counts = self.ranged.where(F.col("__range").isin([r for r, _ in places.values()])).groupBy("__range", F.col(f"`{self.name}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("__range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        stacked = counts.select("__range", "v", (upto - F.col("n")).alias("low"), upto.alias("high"))
        hits = F.lit(False)
        for r, offset in places.values():
            hits = hits | ((F.col("__range") == r) & (F.col("low") <= offset) & (F.col("high") > offset))
        rows = stacked.where(hits).collect()  # one row a place
        return {p: next(x["v"] for x in rows if x["__range"] == r and x["low"] <= o < x["high"]) for p, (r, o) in places.items()}


def running(df: DataFrame, order: list[Key], wants: dict[str, tuple[Column, str]]) -> DataFrame:
    """df with running SUMs, COUNTs, AVERAGEs, MINs and MAXs along the order, by name: (value, how).

    The order is cut once for all of them, and one table with a row a range carries their totals.
    """
    values = {f"__v{i}": v for i, (v, _) in enumerate(wants.values())}
    ranged = ranges(df, order).withColumns(values)
    own = Window.partitionBy("__range").orderBy(*keys_of(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # few rows
    per, start, out, dropped = [], [F.col("__range")], {}, [*values, "__range"]
    for v, (name, (_, how)) in zip(values, wants.items(), strict=True):
        s, c = f"{v}_s", f"{v}_c"
        dropped += [s, c]
        if how in ("MIN", "MAX"):
            agg, pick = {"MIN": (F.min, F.least), "MAX": (F.max, F.greatest)}[how]
            per += [agg(v).alias(s), F.count(v).alias(c)]
            start += [agg(s).over(before).alias(s), F.lit(0).alias(c)]
            out[name] = F.coalesce(pick(agg(v).over(own), F.col(s)), F.lit(0.0))
            continue
        per += [F.sum(v).alias(s), F.count(v).alias(c)]
        start += [F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in (s, c)]
        total, n = F.coalesce(F.sum(v).over(own), F.lit(0.0)) + F.col(s), F.count(v).over(own) + F.col(c)
        out[name] = {"SUM": total, "COUNT": n.cast("double"), "AVERAGE": F.try_divide(total, n)}[how]
    starts = ranged.groupBy("__range").agg(*per).select(*start)
    return ranged.join(F.broadcast(starts), "__range").withColumns(out).drop(*dropped)


def framed(df: DataFrame, order: list[Key], columns: dict[str, tuple[int, int, Callable]], block: int = 50_000) -> DataFrame:
    """df with window expressions, by name: (low, high, expression over the rows from low to high around each row).

    Rows are numbered, cut into blocks of consecutive numbers, and each block gets the rows just
    outside it too (the halo), so that a frame never needs another block.
    """
    rows = with_ordinal(df, order, "__n")
    back, ahead = max(0, *(-low for low, _, _ in columns.values())), max(0, *(high for _, high, _ in columns.values()))
    first = F.floor((F.col("__n") - 1) / block)
    touched = F.sequence(F.greatest(F.floor((F.col("__n") - 1 - ahead) / block), F.lit(0)), F.floor((F.col("__n") - 1 + back) / block))
    spread = rows.withColumn("__own", first).withColumn("__block", F.explode(touched))
    window = Window.partitionBy("__block").orderBy("__n")
    out = spread.withColumns({name: make(window.rowsBetween(low, high)) for name, (low, high, make) in columns.items()})
    return out.where(F.col("__block") == F.col("__own")).drop("__n", "__own", "__block")


def ranked(df: DataFrame, value: str, wants: dict[str, tuple[bool, bool]]) -> DataFrame:
    """df with ranks of a value among all rows, by name: (descending, average of ties).

    Rows are counted by value first and values are ranked, once for all ranks.
    """
    counts = df.where(F.col(f"`{value}`").isNotNull()).groupBy(F.col(f"`{value}`").alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    ranged = ranges(counts, [("__value", True)])
    start = carried(ranged, [F.sum("__n")], ["__before"])
    own = Window.partitionBy("__range").orderBy("__value").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("__n").over(own), F.lit(0)) + F.col("__before")
    placed = ranged.join(F.broadcast(start), "__range").select("__value", "__n", below.alias("__below"))
    found = df.join(placed, F.col(f"`{value}`") == F.col("__value"), "left")
    total = counts.agg(F.sum("__n").alias("__total"))  # one row
    if any(descending for descending, _ in wants.values()):
        found = found.crossJoin(F.broadcast(total))
    ties = (F.col("__n") - 1) / 2
    ranks = {n: (F.col("__total") - F.col("__below") - F.col("__n") if descending else F.col("__below")) + 1 + (ties if average else 0) for n, (descending, average) in wants.items()}
    return found.withColumns({n: r.cast("double") for n, r in ranks.items()}).drop("__value", "__n", "__below", "__total")
