"""Criteria with a bound of the row: exact at the bound, whatever the spread of the keys, and few passes over the facts."""

import math
import random

import pytest

from cellweave import Book

FORMULAS = {
    "below": '=MAXIFS(f[v],f[g],[@g],f[k],"<"&[@b])',
    "above": '=MINIFS(f[v],f[g],[@g],f[k],">"&[@b])',
    "sum": '=SUMIFS(f[v],f[g],[@g],f[k],">="&[@b])',
    "all": '=COUNTIFS(f[k],"<="&[@b])',
    "least": '=MINIFS(f[v],f[k],"<"&[@b])',
}


def asked(spark, facts, asks, kind, formulas=FORMULAS):
    book = Book(spark).table("f", spark.createDataFrame(facts, f"g {kind}, k double, v double"), ["k"]).table("a", spark.createDataFrame(asks, f"i int, g {kind}, b double"), ["i"])
    return {r["i"]: r for r in book.select("a", formulas, ["i"]).collect()}


@pytest.mark.parametrize("groups", [range(40), [7] * 9 + [8], [None, 0, 3], "abcdefgh", "aaaaaaaaab"])
def test_folds_up_to_a_bound_agree_with_brute_force(spark, groups):
    rng, groups = random.Random(11), list(groups)
    kind = "string" if isinstance(groups[0], str) else "int"
    facts = [(rng.choice(groups), float(rng.randrange(60)), rng.choice([None, *map(float, range(-50, 50))])) for _ in range(900)]
    asks = [(i, rng.choice(groups + ["z" if kind == "string" else 99]), float(rng.randrange(-5, 66))) for i in range(200)]
    got = asked(spark, facts, asks, kind)
    same = (lambda a, b: a == b) if kind == "string" else (lambda a, b: (a or 0) == (b or 0))
    for i, g, b in asks:
        if g is None:
            continue
        mine = [(k, v) for h, k, v in facts if same(g, h)]
        kept = lambda rows, test: [v for k, v in rows if test(k) and v is not None]
        r = got[i]
        assert r["below"] == max(kept(mine, lambda k: k < b), default=0)
        assert r["above"] == min(kept(mine, lambda k: k > b), default=0)
        assert r["sum"] == pytest.approx(sum(kept(mine, lambda k: k >= b)))
        assert r["all"] == sum(k <= b for _, k, _ in facts)
        assert r["least"] == min((v for _, k, v in facts if k < b and v is not None), default=0)


def test_strict_bounds_leave_out_the_bound_alone(spark):
    facts = [("x", k, k) for b in (1e-16, 3.0) for k in (math.nextafter(b, 0), b, math.nextafter(b, 9))]
    got = asked(spark, facts, [(0, "x", 3.0), (1, "x", 1e-16)], "string")
    assert (got[0]["below"], got[0]["above"]) == (math.nextafter(3, 0), math.nextafter(3, 9))
    assert (got[1]["below"], got[1]["above"]) == (math.nextafter(1e-16, 0), math.nextafter(1e-16, 9))


def test_a_bound_with_a_key_reads_the_facts_once(spark, tmp_path):
    spark.createDataFrame([(i % 50, float(i), float(i)) for i in range(1000)], "g int, k double, v double").write.parquet(str(tmp_path / "f"))
    book = Book(spark).table("f", spark.read.parquet(str(tmp_path / "f")), ["k"]).table("a", spark.range(50).selectExpr("cast(id as int) i", "cast(id as int) g", "500d b"), ["i"])
    plan = book.select("a", {"x": FORMULAS["above"]}, ["i"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
