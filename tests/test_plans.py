"""Formulas over tables: results against DuckDB or plain Python, and the shape of plans."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from cellweave import Book
from cellweave.interpreter import Interpreter
from cellweave.plans.columns import Unsupported
from cellweave.queries import QUERIES, SQL
from cellweave.values import Error
from tools.verify_local import TABLES, normal

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
        assert normal(got).equals(normal(want))
    else:
        assert len(got) > 0


ROWS = [
    (1, 5.0, "apple", True, dt.date(2024, 1, 31), "12"),
    (2, -2.5, "Banana", False, dt.date(1999, 12, 31), "x"),
    (3, 0.0, None, None, None, " 7 "),
    (4, None, "", True, dt.date(2024, 2, 29), "90%"),
    (5, 1e10, "a-b-c", False, dt.date(1900, 3, 1), None),
]


@pytest.fixture(scope="module")
def small(spark):
    df = spark.createDataFrame(ROWS, "id int, x double, s string, b boolean, d date, n string")
    return Book(spark).table("t", df, ["id"])


#: Formulas whose plan must give what the interpreter gives on every row.
SAME = [
    "=[@x]+1", "=[@x]/2", "=1/[@x]", "=-[@x]", "=[@x]%", "=[@x]^2", "=[@n]*2", "=[@b]+1", "=[@x]&\"!\"", "=[@s]&[@id]", "=[@x]>1", "=[@s]=\"APPLE\"", "=[@n]=12", "=[@b]=TRUE", "=[@x]=[@id]",
    "=IF([@x]>0,\"p\",\"n\")", "=IF([@s],1,2)", "=IFERROR(1/[@x],-1)", "=AND([@b],[@x]>0)", "=OR([@b],[@x]>0)", "=NOT([@b])", "=XOR([@b],TRUE)", "=IFS([@x]>1,\"a\",[@x]<0,\"b\")", "=SWITCH([@id],1,\"one\",2,\"two\",\"more\")", "=CHOOSE([@id],10,20,30)",
    "=ABS([@x])", "=ROUND([@x]/3,2)", "=ROUNDUP([@x],0)", "=TRUNC([@x]/3,1)", "=INT([@x])", "=MOD([@x],3)", "=SQRT([@x])", "=LN([@x])", "=LOG10([@x])", "=EVEN([@x])", "=ODD([@x])", "=SIGN([@x])", "=CEILING([@x],2)", "=MROUND([@id],2)", "=FACT([@id])", "=COMBIN([@id]+3,2)", "=POWER([@x],0.5)", "=EXP([@id])", "=BITAND([@id],3)", "=QUOTIENT([@x],2)", "=ASIN([@x])", "=ATAN2([@x],[@id])", "=SEC([@id])", "=ACOTH([@id])",
    "=LEN([@s])", "=UPPER([@s])", "=PROPER([@s])", "=LEFT([@s],2)", "=RIGHT([@s],2)", "=MID([@s],2,2)", "=TRIM([@n])", "=FIND(\"a\",[@s])", "=SEARCH(\"B\",[@s])", "=SUBSTITUTE([@s],\"a\",\"*\")", "=SUBSTITUTE([@s],\"-\",\"+\",2)", "=REPT([@s],2)", "=EXACT([@s],\"apple\")", "=TEXTBEFORE([@s],\"-\")", "=TEXTAFTER([@s],\"-\")", "=VALUE([@n])", "=TEXT([@x],\"0.0\")", "=REPLACE([@s],1,1,\"Z\")", "=CONCATENATE([@s],[@b],[@x])", "=TEXTJOIN(\",\",TRUE,[@s],[@n])", "=FIXED([@x],1)", "=DOLLAR([@x])", "=UNICODE([@s])", "=ROMAN([@id])",
    "=YEAR([@d])", "=MONTH([@d])", "=DAY([@d])", "=[@d]+1", "=WEEKDAY([@d])", "=WEEKDAY([@d],2)", "=WEEKNUM([@d])", "=DAYS([@d],DATE(2000,1,1))", "=DATEDIF([@d],DATE(2025,1,1),\"Y\")", "=DATE(2024,[@id],15)+0", "=EOMONTH([@d],[@id])+0", "=EDATE([@d],-1)+0", "=DAYS360([@d],DATE(2025,3,31))", "=YEARFRAC([@d],DATE(2025,1,1),3)", "=NETWORKDAYS([@d],DATE(2024,12,31))", "=HOUR([@x])",
    "=ISBLANK([@s])", "=ISNUMBER([@x])", "=ISTEXT([@s])", "=ISERROR(1/[@x])", "=ISNA([@x])", "=N([@b])", "=T([@s])", "=TYPE([@s])", "=ERROR.TYPE(1/[@x])",
    "=PMT(0.01,12,[@x])", "=FV(0.01,[@id],-10)", "=PV(0,[@id],-10)", "=SLN([@x],1,[@id])", "=EFFECT(0.1,[@id])", "=IPMT(0.01,[@id],12,100)", "=NORM.DIST([@id],2,1,TRUE)", "=BINOM.DIST([@id],10,0.5,FALSE)", "=LET(a,[@x],a+a)", "=LAMBDA(v,v*2)([@id])",
    "=DEC2BIN([@id])", "=DEC2HEX([@x])", "=DEC2OCT([@x],8)", "=DEC2BIN(-[@id],3)", "=DEC2HEX([@id],[@x])", "=BIN2DEC([@n])", "=HEX2DEC([@s])", "=HEX2DEC(DEC2HEX(-[@id]))", "=OCT2HEX([@id],4)", "=HEX2BIN([@id]*100)", "=BASE([@id]*1000,36)", "=BASE([@x],2,6)", "=BASE([@id],[@x])",
    "=BITLSHIFT([@id],40)", "=BITLSHIFT([@id],-1)", "=BITLSHIFT([@x],[@id])", "=BITRSHIFT([@id]*9,[@x])", "=BITRSHIFT([@id],60)", "=CHAR([@id]+126)", "=CHAR([@x])", "=CODE([@s])", "=CODE([@n])", "=CODE(CHAR([@id]+127))", "=CODE(UNICHAR(8000+[@id]))", "=UNICHAR([@id]*40000)", "=UNICHAR(65278+[@id])", "=UNICHAR([@x])",
    "=ADDRESS([@id],[@id]*26)", "=ADDRESS([@id],[@id]*702,4)", "=ADDRESS([@x],16384,2)", "=ADDRESS([@id],16380+[@id]*2,3)", "=ADDRESS([@id],1,1,FALSE)", "=FACTDOUBLE([@id]*3)", "=FACTDOUBLE([@x])", "=COMBINA([@id],3)", "=COMBINA([@x],[@id])", "=EXPONDIST([@x],0.5,TRUE)", "=WEIBULL([@x],2,3,FALSE)",
    "=WORKDAY([@d],[@id])", "=WORKDAY([@d],-[@id]*3)", "=WORKDAY([@d]+[@id],[@x])", "=WORKDAY([@x],7)", "=WORKDAY([@d],0)", "=WORKDAY([@id],-1)", "=WORKDAY([@id]*20,30)", "=WORKDAY(57+[@id],-[@id])", "=WORKDAY(54+[@id],[@id])", "=YEARFRAC([@d],DATE(2020,1,1),2)", "=YEARFRAC([@d],[@x],[@id])", "=TBILLPRICE([@d],[@d]+90,[@x]/100)", "=TBILLYIELD([@d],[@d]+[@id],98)", "=TBILLEQ([@d],[@d]+200+[@id],0.05)", "=TBILLEQ([@d],[@d]+[@id],[@x])", "=TBILLEQ([@d],[@d]+365,0.05)",
    "=DOLLARDE([@x]+1.02,16)", "=DOLLARDE([@x],[@id])", "=DOLLARFR([@x],[@id]*50)", "=DOLLARFR([@id]/3,8)",
]


@pytest.mark.parametrize("formula", SAME)
def test_rows_agree_with_the_interpreter(small, formula):
    from cellweave.formula.nodes import Literal, Node, TableRef
    from cellweave.formula.parser import parse
    from cellweave.interpreter import Frame
    from cellweave.values import to_serial

    got = {r["id"]: (r["v"], r["v__err"]) for r in small.select("t", {"v": formula}, ["id"], errors=True).collect()}
    names = ["id", "x", "s", "b", "d", "n"]

    class Blank(Literal):
        pass

    def fill(node: Node, row) -> Node:
        if isinstance(node, TableRef):
            return Literal(to_serial(row[names.index(node.first)]))
        return node.map(lambda n: fill(n, row))

    for row in ROWS:
        want = Interpreter().result(fill(parse(formula), row), Frame())
        v, e = got[row[0]]
        if isinstance(want, Error):
            assert e == want.kind, (row, v, e, want)
        elif want is None:
            assert v is None and e is None
        elif isinstance(want, bool) or isinstance(want, str):
            assert v == want and e is None, (row, v, e, want)
        else:
            v = to_serial(v) if isinstance(v, dt.date) else v
            assert e is None and math.isclose(v, want, rel_tol=1e-9, abs_tol=1e-12), (row, v, e, want)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def book(spark):
    out = Book(spark)
    for t, k in {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey"}.items():
        out.table(t, spark.read.parquet(f"{DATA}/{t}.parquet"), [k])
    out.table("lineitem", spark.read.parquet(f"{DATA}/lineitem.parquet"))
    return out


def test_scalar_functions_stay_in_the_jvm(book):
    text = plan(book.select("orders", {"a": "=ROUND([@o_totalprice]*1.1,2)", "b": "=UPPER([@o_orderstatus])&YEAR([@o_orderdate])", "c": "=IFERROR(1/([@o_totalprice]-5),0)"}))
    assert "Python" not in text and "Arrow" not in text


def test_notations_and_bills_stay_in_the_jvm_as_small_plans(book):
    text = plan(book.select("orders", {"a": "=HEX2OCT(DEC2HEX(MOD([@o_orderkey],512)))", "b": "=BASE([@o_orderkey],7)&CHAR(65)", "c": "=TBILLEQ(DATE(2024,1,1),DATE(2024,4,1),[@o_totalprice]/1E7)", "d": "=ADDRESS([@o_orderkey]+1,2)", "e": "=BITLSHIFT([@o_orderkey],2)"}))
    assert "Python" not in text and "Arrow" not in text and len(text) < 20000


def test_only_needed_columns_are_read_and_filters_reach_the_scan(book):
    df = book.query('=FILTER(orders[o_orderkey],(orders[o_totalprice]>400000)*(orders[o_orderstatus]="F"))')
    text = plan(df)
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in text


def test_reductions_of_a_table_share_one_pass(book):
    df = book.scalars({"a": "=SUM(lineitem[l_quantity])", "b": "=AVERAGE(lineitem[l_tax])", "c": '=COUNTIF(lineitem[l_returnflag],"R")'})
    assert plan(df).count("FileScan") == 1


def test_lookups_with_one_key_share_one_join(book):
    df = book.select("orders", {"a": "=XLOOKUP([@o_custkey],customer[c_custkey],customer[c_name])", "b": "=XLOOKUP([@o_custkey],customer[c_custkey],customer[c_acctbal])"})
    assert plan(df).count("Join") == 1


def test_group_joins_with_one_key_share_one_join(book):
    df = book.select("customer", {"a": "=COUNTIFS(orders[o_custkey],[@c_custkey])", "b": "=SUMIFS(orders[o_totalprice],orders[o_custkey],[@c_custkey])"})
    assert plan(df).count("Join") == 1


def test_top_rows_do_not_sort_everything(book):
    assert "TakeOrdered" in plan(book.query("=TAKE(SORT(CHOOSECOLS(orders,1,4),2,-1),10)"))


def test_windows_are_partitioned(book):
    """No window over a whole table gathers its rows in one task: those left order a row a range."""
    df = book.select("customer", {"r": "=RANK.EQ([@c_acctbal],customer[c_acctbal])"}, ["c_custkey"])
    assert df.count() == 150


def test_computed_columns_build_on_each_other(spark):
    b = Book(spark).table("t", spark.createDataFrame([(1, 2.0)], "k int, v double"), ["k"])
    b.column("t", "c", "=[@b]+1").column("t", "b", "=[@v]*2")
    assert b.frame("t").first()["c"] == 5.0
    b.column("t", "v2", "=[@w]").column("t", "w", "=[@v2]")
    with pytest.raises(Unsupported, match="CIRC"):
        b.frame("t")


def test_names_and_custom_functions(spark):
    b = Book(spark).table("t", spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double"), ["k"])
    b.name("rate", 0.5).name("twice", "=LAMBDA(x,x*2)").register("HALVE", lambda x: x / 2, 1, 1).register("TAG", lambda x: f"<{x:g}>", 1, 1, returns="text")
    got = b.select("t", {"a": "=[@v]*rate", "b": "=twice([@v])", "c": "=HALVE([@v])", "d": "=TAG([@v])"}, ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 4.0, 1.0, "<2>"), (2, 1.5, 6.0, 1.5, "<3>")]
    b.unregister("HALVE").unregister("TAG")
    with pytest.raises(ValueError):
        b.register("SUM", sum)


def test_fill_of_whole_column_values(spark):
    df = spark.range(1, 2001).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    b = Book(spark).table("t", df, ["k"])
    got = b.select("t", {"run": "=SUM(B$1:B1)", "avg": "=AVERAGE(B1:B3)", "row": "=ROW()"}, ["k"], anchor=1)
    rows = {r.k: r for r in got.collect()}
    v = [k % 7 for k in range(0, 2003)]
    for k in (1, 2, 999, 1500, 2000):
        assert rows[k].run == sum(v[1 : k + 1]) and rows[k].row == k
        part = [v[i] for i in range(k, min(k + 3, 2001))]
        assert rows[k].avg == pytest.approx(sum(part) / len(part))


def test_descending_and_text_orders(spark):
    df = spark.createDataFrame([(s,) for s in ["pear", "fig", "apple", "Zebra", "kiwi"] * 3 + [None]], "s string")
    b = Book(spark).table("t", df.withColumn("i", F.monotonically_increasing_id()), [("s", False), "i"])
    got = [r[0] for r in b.query("=TAKE(t[s],4)").collect()]
    assert sorted(got) == ["kiwi", "pear", "pear", "pear"]


def test_filter_with_fallback(book):
    assert [tuple(r) for r in book.query('=FILTER(part[p_partkey],part[p_size]>999,0)').collect()] == [(0,)]


def test_xlookup_skewed_and_missing(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1000, 1).otherwise(F.col("id")).alias("k"))
    right = spark.createDataFrame([(1, "one", 1), (1, "uno", 2), (5000, "x", 3)], "k int, v string, o int")
    b = Book(spark).table("l", left.withColumn("i", F.monotonically_increasing_id()), ["i"]).table("r", right, ["o"])
    got = b.select("l", {"v": '=XLOOKUP([@k],r[k],r[v],"none")', "w": '=XLOOKUP([@k],r[k],r[v],"none",0,-1)'}, ["k"])
    assert {tuple(r) for r in got.select("k", "v", "w").where("k = 1 or k = 2000").distinct().collect()} == {(1, "one", "uno"), (2000, "none", "none")}
    assert got.count() == 3000


def test_irr_over_a_column(spark):
    b = Book(spark).table("f", spark.createDataFrame([(0, -100.0), (1, 60.0), (2, 60.0)], "t int, v double"), ["t"])
    assert b.value("=IRR(f[v])") == pytest.approx(0.1306623862918, rel=1e-9)
    assert b.value("=MIRR(f[v],0.1,0.12)") == pytest.approx(math.sqrt((60 * 1.12 + 60) / 100) - 1)


def test_errors_of_reductions(spark):
    b = Book(spark).table("t", spark.createDataFrame([("a", 1.0)], "s string, v double"), ["s"])
    assert b.value("=AVERAGE(t[s])") == "#DIV/0!" and b.value("=STDEV.S(t[v])") == "#DIV/0!" and b.value("=SUM(1/(t[v]-1))") == "#DIV/0!" and b.value("=LARGE(t[v],2)") == "#NUM!"


def test_hidden_rows(spark):
    df = spark.createDataFrame([(1, 10.0, False), (2, 20.0, True)], "k int, v double, h boolean")
    b = Book(spark).table("t", df, ["k"], hidden=F.col("h"))
    assert b.value("=SUBTOTAL(9,t[v])") == 30 and b.value("=SUBTOTAL(109,t[v])") == 10 and b.value("=AGGREGATE(9,1,t[v])") == 10


def test_membership_tests_are_semi_and_anti_joins(book):
    assert "LeftSemi" in plan(book.query("=FILTER(customer[c_custkey],ISNUMBER(MATCH(customer[c_custkey],orders[o_custkey],0)))"))
    assert "LeftAnti" in plan(book.query("=FILTER(customer[c_custkey],COUNTIF(orders[o_custkey],customer[c_custkey])=0)"))


def test_xlookup_of_a_constant(book):
    assert [tuple(r) for r in book.query("=XLOOKUP(3,customer[c_custkey],customer[c_name])").collect()] == [("Customer#000000003",)]
    assert [tuple(r) for r in book.query('=XLOOKUP(-3,customer[c_custkey],customer[c_acctbal],"none")').collect()] == [("none",)]


def test_constant_arrays_reach_the_library(small):
    got = {r["id"]: tuple(r)[1:] for r in small.select("t", {"a": "=SERIESSUM([@id],0,1,{1,2})", "b": "=NETWORKDAYS(45292,45292+[@id],{45293})"}, ["id"]).collect()}
    assert got[1] == (3.0, 1.0) and got[3] == (7.0, 3.0)


def test_group_join_counts_with_several_kinds_of_criteria(spark):
    left = spark.createDataFrame([(i, "k%d" % (i % 3), float(i)) for i in range(30)], "id int, k string, v double")
    right = spark.createDataFrame([("K1", 5.0, "x"), ("k1", 7.0, "y"), ("k2", 1.0, "x"), (None, 9.0, "x")], "k string, v double, t string")
    b = Book(spark).table("l", left, ["id"]).table("r", right, ["v"])
    got = {r.id: (r.a, r.b, r.c) for r in b.select("l", {"a": "=SUMIFS(r[v],r[k],[@k])", "b": '=COUNTIFS(r[k],[@k],r[t],"X")', "c": '=SUMIFS(r[v],r[v],"<="&[@v])'}, ["id"]).collect()}
    for i in range(30):
        mine = [(v, t) for k, v, t in [("k1", 5, "x"), ("k1", 7, "y"), ("k2", 1, "x")] if k == f"k{i % 3}"]
        assert got[i] == (sum(v for v, _ in mine), sum(t == "x" for _, t in mine), sum(v for v in (5, 7, 1, 9) if v <= i))
