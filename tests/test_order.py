"""Order operators: even ranges, and results that do not depend on where the order is cut."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellweave import Book
from cellweave.operators import lookup, order


def sizes(df, keys, n=8):
    return sorted(Counter(r[0] for r in order.ranges(df, keys, n).select("__range").collect()).values())


def test_texts_with_a_common_prefix_are_cut_evenly(spark):
    df = spark.range(4000).select(F.format_string("Customer#%09d", "id").alias("name"))
    assert len(sizes(df, [("name", True)])) == 8 and sizes(df, [("name", True)])[-1] <= 700


@pytest.mark.parametrize("up", [True, False])
def test_a_status_is_cut_by_what_follows_it(spark, up):
    df = spark.range(4000).select(F.when(F.col("id") % 10 < 8, "O").otherwise("P").alias("s"), F.col("id").alias("i"), F.lit("same").alias("c"))
    found = sizes(df, [("c", True), ("s", up), ("i", True)])
    assert len(found) >= 7 and found[-1] <= 1200
    numbered = order.with_ordinal(df, [("s", up), ("i", True)], "at").orderBy("at").collect()
    assert [r["at"] for r in numbered] == list(range(1, 4001))
    assert [(r["s"], r["i"]) for r in numbered] == sorted(((r["s"], r["i"]) for r in numbered), key=lambda r: ((r[0] == "P") == up, r[1]))


def test_nulls_come_first_upward_and_last_downward(spark):
    rows = [(None,), ("b",), (None,), ("a",), ("",)]
    df = spark.createDataFrame(rows, "v string")
    for up, want in ((True, [None, None, "", "a", "b"]), (False, ["b", "a", "", None, None])):
        assert [r["v"] for r in order.with_ordinal(df, [("v", up)], "at").orderBy("at").collect()] == want


@pytest.mark.parametrize("larger", [False, True])
def test_nearest_within_parts_of_uneven_size(spark, larger):
    rng = random.Random(3)
    right = [(rng.choice("aaaaaab"), float(rng.randrange(500))) for _ in range(300)]
    left = [(i, rng.choice("aaaaaabc"), rng.choice([float(rng.randrange(500)), 250.0])) for i in range(600)]
    l, r = spark.createDataFrame(left, "i int, p string, k double"), spark.createDataFrame(right, "q string, x double")
    got = lookup.nearest(l, F.col("k"), r, F.col("x"), {"hit": F.col("x")}, larger=larger, partition=(F.col("p"), F.col("q")))
    pick = min if larger else max
    for row in got.collect():
        near = [x for q, x in right if q == row["p"] and (x >= row["k"] if larger else x <= row["k"])]
        assert row["hit"] == (pick(near) if near else None)
        assert row["__found"] == bool(near)


def test_criteria_between_bounds_of_the_row_and_reductions_of_filter(spark):
    rng = random.Random(5)
    facts = [(i, rng.choice("xxxxy"), float(rng.randrange(100)), rng.choice(["p", "q", None])) for i in range(200)]
    asks = [(i, rng.choice("xyz"), float(rng.randrange(-10, 110)), float(rng.randrange(-10, 110))) for i in range(60)]
    book = Book(spark).table("f", spark.createDataFrame(facts, "i int, g string, v double, t string"), ["i"]).table("a", spark.createDataFrame(asks, "i int, g string, lo double, hi double"), ["i"])
    got = book.select("a", {
        "n": '=COUNTIFS(f[v],">="&[@lo],f[v],"<"&[@hi])',
        "s": '=SUMIFS(f[v],f[g],[@g],f[v],">"&[@lo],f[v],"<="&[@hi])',
        "x": '=MAXIFS(f[v],f[g],[@g],f[v],"<"&[@hi])',
        "md": "=IFERROR(MEDIAN(FILTER(f[v],f[g]=[@g])),-1)",
        "l3": "=IFERROR(LARGE(FILTER(f[v],f[g]=[@g]),3),-1)",
        "tj": '=IFERROR(TEXTJOIN(",",TRUE,FILTER(f[t],f[g]=[@g])),"none")',
    }, ["i"])
    found = {r["i"]: r for r in got.collect()}
    for i, g, lo, hi in asks:
        mine = sorted(v for _, h, v, _ in facts if h == g)
        below = [v for v in mine if v < hi]
        r = found[i]
        assert r["n"] == sum(lo <= v < hi for _, _, v, _ in facts)
        assert r["s"] == pytest.approx(sum(v for v in mine if lo < v <= hi))
        assert r["x"] == (max(below) if below else 0)
        assert r["md"] == ((mine[(len(mine) - 1) // 2] + mine[len(mine) // 2]) / 2 if mine else -1)
        assert r["l3"] == (mine[-3] if len(mine) > 2 else -1)
        assert r["tj"] == (",".join(t for _, h, _, t in facts if h == g and t) if mine else "none")
