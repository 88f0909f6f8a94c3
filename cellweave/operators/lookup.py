"""Lookups as joins: exact, nearest and by pattern."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import Cut, cutter


def key(c: Column, kind: T.DataType) -> Column:
    """Keys compare without case, and a blank key as 0 or empty text."""
    if isinstance(kind, T.StringType):
        return F.lower(F.coalesce(c, F.lit("")))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    return c


def deduplicated(right: DataFrame, key_col: Column, order: list[Column], last: bool, values: dict[str, Column]) -> DataFrame:
    """(__key, __hit): the first (or last) row of each key, combined before the shuffle."""
    place = F.struct(*order) if order else F.struct(F.monotonically_increasing_id())
    pick = F.max_by if last else F.min_by
    hit = F.struct(*[v.alias(n) for n, v in values.items()])
    return right.groupBy(key_col.alias("__key")).agg(pick(hit, place).alias("__hit"))


def exact(left: DataFrame, left_key: Column, right: DataFrame, right_key: Column, order: list[Column], values: dict[str, Column], last: bool = False) -> DataFrame:
    """left with the columns ``values`` of the matching row and __found.

    The side that is looked up has one row a key, so left keeps its rows; Spark broadcasts it when it
    is small and splits hot keys of left when it is not.
    """
    found = deduplicated(right, right_key, order, last, values)
    joined = left.withColumn("__lkey", left_key).join(found, F.col("__lkey") == F.col("__key"), "left")
    out = joined.withColumns({n: F.col(f"__hit.{n}") for n in values} | {"__found": F.col("__key").isNotNull()})
    return out.drop("__lkey", "__key", "__hit")


def nearest(left: DataFrame, left_key: Column, right: DataFrame, right_key: Column, values: dict[str, Column], larger: bool = False, partition: tuple[Column, Column] | None = None, base: DataFrame | None = None) -> DataFrame:
    """As exact, with the row of the largest key not above the wanted one (or the smallest not below).

    Both sides stand in one order, cut into ranges; the last looked-up row before a range is carried
    into it. With a partition (a left and a right column that must agree) the order is by partition first,
    so that one that holds most rows is many ranges. base: a frame with the rows of left before other steps;
    where it has the wanted keys, the ranges are found on it.
    """
    part_of_hit = partition[1] if partition else F.lit(0)
    hit = F.struct(part_of_hit.alias("p"), right_key.alias("k"), F.struct(*[v.alias(n) for n, v in values.items()]).alias("v"))
    # of equal keys the last counts, as in a sorted search
    looked = right.select((partition[1] if partition else F.lit(0)).alias("__part"), right_key.alias("__k"), F.lit(0 if not larger else 1).alias("__side"), hit.alias("__hit"))
    looked = looked.where("__k is not null").groupBy("__part", "__k", "__side").agg(F.max("__hit").alias("__hit"))
    names = left.columns
    asked = left.select((partition[0] if partition else F.lit(0)).alias("__part"), left_key.alias("__k"), F.lit(1 if not larger else 0).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    both = asked.withColumn("__hit", F.lit(None).cast(looked.schema["__hit"].dataType)).unionByName(looked.withColumn("__row", F.lit(None).cast(asked.schema["__row"].dataType)))
    keys = [F.col("__k").desc() if larger else F.col("__k").asc(), F.col("__side").desc() if larger else F.col("__side").asc()]
    place, every, *_ = _cut(left, left_key, base, looked, larger, partition)
    if partition:  # keys are numbers here
        end = F.max_by("__hit", F.struct("__hit.p", -F.col("__hit.k") if larger else F.col("__hit.k")))
    else:
        end = (F.min_by if larger else F.max_by)("__hit", "__hit.k")
    # only the looked-up side carries from range to range, also across ranges without any of it
    per = looked.withColumn("__range", place).groupBy("__range").agg(end.alias("__carry"))
    held = left.sparkSession.createDataFrame([(r,) for r in every], "__range long").join(per, "__range", "left")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # few rows
    carry = held.select("__range", F.last("__carry", ignorenulls=True).over(before).alias("__carry"))
    window = Window.partitionBy("__range", "__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    before_it = F.when(F.col("__carry.p") == F.col("__part"), F.col("__carry"))
    done = both.withColumn("__range", place).join(F.broadcast(carry), "__range").withColumn("__got", F.coalesce(F.last("__hit", ignorenulls=True).over(window), before_it))
    found = done.where("__row is not null")
    return found.select("__row.*", *[F.col(f"__got.v.{n}").alias(n) for n in values], F.col("__got").isNotNull().alias("__found"))


def _cut(left: DataFrame, left_key: Column, base: DataFrame | None, looked: DataFrame, larger: bool, partition: tuple[Column, Column] | None) -> Cut:
    wanted = [(partition[0] if partition else F.lit(0)).alias("__part"), left_key.alias("__k")]
    try:
        keyed = (left if base is None else base).select(*wanted)
    except AnalysisException:
        keyed = left.select(*wanted)
    return cutter(keyed.unionByName(looked.select("__part", "__k")), ([("__part", True)] if partition else []) + [("__k", not larger)])


def reduced_upto(left: DataFrame, part: Column | None, bound: Column, facts: DataFrame, how: str, wants: tuple[str, str], upward: bool, strict: bool, base: DataFrame | None = None, alike: bool = False) -> DataFrame:
    """left with the "sum", "max" or "min" and the count of the values v of those facts whose __k is not beyond a
    bound (strict: nor equal to it) and, with a part, whose __part agrees; named by wants.

    facts: (__part, __k, v), none without a key. Both sides stand in one order and one window folds along it. A
    part goes to one task, unless some part fills several ranges of the order: then, and without parts, ranges are
    the tasks, and the fold of a range's last part is carried on. base: as in nearest. alike: the bounds are spread as
    the facts' keys, which alone are looked at for the ranges.
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    join = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}[how]
    order = ([("__part", True)] if part is not None else []) + [("__k", upward)]
    own = part if part is not None else F.lit(0)
    keys = facts.select("__part", "__k")
    cut = cutter(keys, order) if alike else _cut(left, bound, base, keys, not upward, (own, F.col("__part")) if part is not None else None)
    ranged = part is None or cut.split
    if part is None or not cut.even:
        facts = facts.groupBy("__part", "__k").agg(fold("v").alias("__s"), F.count("v").alias("__c"))
    else:
        facts = facts.select("__part", "__k", F.col("v").alias("__s"), F.when(F.col("v").isNotNull(), 1).otherwise(0).cast("long").alias("__c"))
    names = left.columns
    asked = left.select(*[F.col(f"`{c}`") for c in names], own.alias("__part"), bound.alias("__k"), F.lit(True).alias("__asks"))
    both = asked.unionByName(facts.withColumn("__asks", F.lit(False)), allowMissingColumns=True)
    by = ["__part"]
    if ranged:
        placed = facts.withColumn("__range", cut.place)
        if part is None:
            ends = placed.withColumn("__last", F.lit(0))
        else:
            last = placed.groupBy("__range").agg(F.max("__part").alias("__last"))
            ends = placed.join(F.broadcast(last), "__range").where(F.col("__part") == F.col("__last"))
        ends = ends.groupBy("__range", "__last").agg(fold("__s").alias("__us"), F.sum("__c").alias("__uc"))
        along = Window.partitionBy("__last").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)  # a row a range
        ends = ends.select("__range", F.struct("__last", fold("__us").over(along).alias("s"), F.sum("__uc").over(along).alias("c")).alias("__end"))
        held = left.sparkSession.createDataFrame([(r,) for r in cut.every], "__range long").join(ends, "__range", "left")
        before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # few rows
        carry = held.select("__range", F.last("__end", ignorenulls=True).over(before).alias("__carry"))
        both = both.withColumn("__range", cut.place).join(F.broadcast(carry), "__range")
        by = ["__range", "__part"]
    # at an equal key the facts come before the rows that ask, or after them if they do not count
    side = F.col("__asks").desc() if strict else F.col("__asks").asc()
    window = Window.partitionBy(*by).orderBy(F.col("__k").asc() if upward else F.col("__k").desc(), side).rowsBetween(Window.unboundedPreceding, 0)
    done = both.withColumns({"__here_s": fold("__s").over(window), "__here_c": F.sum("__c").over(window)}).where("__asks")
    s, c = F.col("__here_s"), F.coalesce("__here_c", F.lit(0))
    if ranged:
        mine = F.col("__carry.__last") == F.col("__part")
        far = F.when(mine, F.col("__carry.s"))
        s = F.when(far.isNull(), s).when(s.isNull(), far).otherwise(join(s, far))
        c = c + F.coalesce(F.when(mine, F.col("__carry.c")), F.lit(0))
    known = F.col("__k").isNotNull()
    return done.select(*[F.col(f"`{x}`") for x in names], F.when(known, s).alias(wants[0]), F.when(known, c).alias(wants[1]))


def pattern(left: DataFrame, left_pattern: Column, right: DataFrame, right_key: Column, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """As exact, with the first row whose key matches the left row's pattern (a regular expression).

    Distinct patterns meet distinct keys once, however many rows use them.
    """
    asked = left.select(left_pattern.alias("__p")).where("__p is not null").distinct()
    found = deduplicated(right, right_key, order, False, values | {"__at": F.struct(*order) if order else F.lit(0)})
    met = asked.join(found, F.rlike(F.col("__key"), F.col("__p")), "inner").groupBy("__p").agg(F.min_by("__hit", "__hit.__at").alias("__hit"))
    joined = left.withColumn("__lp", left_pattern).join(met, F.col("__lp") == F.col("__p"), "left")
    return joined.withColumns({n: F.col(f"__hit.{n}") for n in values} | {"__found": F.col("__p").isNotNull()}).drop("__lp", "__p", "__hit")
