"""Queries over the driver's tables, a formula (or a few) each, with the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.book import Book
from .ports import SheetFunction, manifest
from .sources import read_csv, write_csv
from .storage import work_path
from .streaming import windowed
from .workbook import Workbook

#: The order of the rows of each table.
ORDERS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": [],
    "events": ["event_id"],
}


def book(spark: SparkSession, sf_dir: str, *tables: str) -> Book:
    out = Book(spark)
    for t in tables or ORDERS:
        out.table(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"), ORDERS[t])
    if not tables or "lineitem" in tables:
        out.column("lineitem", "net", "=[@l_extendedprice]*(1-[@l_discount])")
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rows(name: str, table: str, formulas: dict[str, str], keep: list[str], sql: str | None, anchor: int | None = None, more: tuple[str, ...] = (), **casts: str) -> None:
    """A query with a row for each row of a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = book(spark, sf_dir, table, *more).select(table, formulas, keep, anchor=anchor)
        return got.withColumns({c: F.col(c).cast(k) for c, k in casts.items()}) if casts else got

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def scalars(name: str, formulas: dict[str, str], tables: tuple[str, ...], sql: str | None, digits: int | None = None) -> None:
    """A query of one row; sums are rounded so that the order of addition does not show."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = book(spark, sf_dir, *tables).scalars(formulas)
        return got.select(*[F.round(c, digits).alias(c) for c in got.columns]) if digits is not None else got

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def spill(name: str, formula: str, tables: tuple[str, ...], sql: str | None, rename: list[str] | None = None, rounded: dict[str, int] | None = None, prepare: Callable[[Book], object] | None = None) -> None:
    """A query of an array formula."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = book(spark, sf_dir, *tables)
        if prepare:
            prepare(b)
        got = b.query(formula)
        got = got.toDF(*rename) if rename else got
        return got.withColumns({c: F.round(c, d) for c, d in (rounded or {}).items()})

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# -- rows: operators and scalar functions ---------------------------------------------------

rows("row_arith", "lineitem", {"net": "=[@l_extendedprice]*(1-[@l_discount])", "gross": "=[@l_extendedprice]*(1-[@l_discount])*(1+[@l_tax])", "back": "=-[@l_quantity]^2", "pct": "=[@l_quantity]%"}, ["l_orderkey", "l_linenumber"],
     "select l_orderkey, l_linenumber, l_extendedprice*(1-l_discount) as net, l_extendedprice*(1-l_discount)*(1+l_tax) as gross, pow(-l_quantity,2) as back, l_quantity/100 as pct from lineitem")
rows("if_text", "orders", {"size": '=IF([@o_totalprice]>150000,"big","small")'}, ["o_orderkey"], "select o_orderkey, case when o_totalprice>150000 then 'big' else 'small' end as size from orders")
rows("ifs_switch", "orders", {"band": '=IFS([@o_totalprice]<50000,"low",[@o_totalprice]<200000,"mid",TRUE,"high")', "word": '=SWITCH([@o_orderstatus],"f","final","O","open","other")', "nth": '=CHOOSE(MOD([@o_orderkey],3)+1,"a","b","c")'}, ["o_orderkey"],
     "select o_orderkey, case when o_totalprice<50000 then 'low' when o_totalprice<200000 then 'mid' else 'high' end as band, case o_orderstatus when 'F' then 'final' when 'O' then 'open' else 'other' end as word, ['a','b','c'][o_orderkey%3+1] as nth from orders")
rows("logic", "lineitem", {"a": '=AND([@l_quantity]>10,[@l_discount]<0.05,[@l_returnflag]="r")', "o": "=OR([@l_quantity]>45,[@l_tax]=0)", "x": "=XOR([@l_quantity]>10,[@l_tax]>0.04)", "n": '=NOT([@l_linestatus]="O")'}, ["l_orderkey", "l_linenumber"],
     "select l_orderkey, l_linenumber, l_quantity>10 and l_discount<0.05 and lower(l_returnflag)='r' as a, l_quantity>45 or l_tax=0 as o, (l_quantity>10) <> (l_tax>0.04) as x, lower(l_linestatus)<>'o' as n from lineitem")
rows("errors", "orders", {"q": "=IFERROR([@o_totalprice]/MOD([@o_orderkey],3),-1)", "e": "=ISERROR(1/MOD([@o_orderkey],2))", "k": "=IFERROR(ERROR.TYPE(1/MOD([@o_orderkey],2)),0)", "n": "=IFNA(IF(MOD([@o_orderkey],2)=0,NA(),1),0)"}, ["o_orderkey"],
     "select o_orderkey, case when o_orderkey%3=0 then -1 else o_totalprice/(o_orderkey%3) end as q, o_orderkey%2=0 as e, case when o_orderkey%2=0 then 2.0 else 0.0 end as k, case when o_orderkey%2=0 then 0.0 else 1.0 end as n from orders")
rows("info", "part", {"t": "=ISTEXT([@p_name])", "n": "=ISNUMBER([@p_size])", "b": "=ISBLANK([@p_brand])", "e": "=ISEVEN([@p_size])", "o": "=ISODD([@p_size])", "k": "=TYPE([@p_name])", "v": "=N([@p_size])"}, ["p_partkey"],
     "select p_partkey, p_name is not null as t, p_size is not null as n, p_brand is null as b, p_size%2=0 as e, p_size%2=1 as o, 2.0::double as k, p_size::double as v from part")
rows("rounding", "lineitem", {"r": "=ROUND([@l_extendedprice],-2)", "d": "=ROUNDDOWN([@l_extendedprice],0)", "u": "=ROUNDUP([@l_extendedprice],0)", "t": "=TRUNC([@l_extendedprice])", "i": "=INT(-[@l_quantity]/7)", "c": "=CEILING([@l_quantity],5)", "f": "=FLOOR([@l_quantity],5)", "m": "=MROUND([@l_quantity],4)", "ev": "=EVEN([@l_quantity])", "od": "=ODD([@l_quantity])", "md": "=MOD(-[@l_quantity],7)", "q": "=QUOTIENT([@l_quantity],7)"}, ["l_orderkey", "l_linenumber"],
     "select l_orderkey, l_linenumber, floor(l_extendedprice/100+0.5)*100 as r, floor(l_extendedprice) as d, ceil(l_extendedprice) as u, trunc(l_extendedprice) as t, floor(-l_quantity/7) as i, ceil(l_quantity/5)*5 as c, floor(l_quantity/5)*5 as f, floor(l_quantity/4+0.5)*4 as m, ceil(l_quantity/2)*2 as ev, greatest(ceil((l_quantity-1)/2)*2+1,1) as od, -l_quantity-7*floor(-l_quantity/7) as md, trunc(l_quantity/7) as q from lineitem")
rows("powers", "part", {"s": "=SQRT([@p_retailprice])", "l": "=LN([@p_retailprice])", "g": "=LOG10([@p_retailprice])", "b": "=LOG([@p_retailprice],2)", "e": "=EXP([@p_size]/50)", "p": "=POWER([@p_size],1.5)", "a": "=ABS(-[@p_size])", "n": "=SIGN(25-[@p_size])", "f": "=FACT(MOD([@p_size],10))", "c": "=COMBIN([@p_size]+2,2)"}, ["p_partkey"],
     "select p_partkey, sqrt(p_retailprice) as s, ln(p_retailprice) as l, log10(p_retailprice) as g, ln(p_retailprice)/ln(2) as b, exp(p_size/50.0::double) as e, pow(p_size,1.5) as p, abs(-p_size)::double as a, sign(25-p_size)::double as n, factorial(p_size%10)::double as f, ((p_size+2)*(p_size+1)/2)::double as c from part")
rows("trigonometry", "part", {"s": "=SIN([@p_size])", "c": "=COS([@p_size])", "t": "=TAN([@p_size])", "a": "=ATAN2([@p_size],2)", "x": "=ASIN([@p_size]/100)", "y": "=ACOS([@p_size]/100)", "d": "=DEGREES([@p_size]/10)", "r": "=RADIANS([@p_size])", "h": "=TANH([@p_size]/50)", "k": "=ACOT([@p_size])"}, ["p_partkey"],
     "select p_partkey, sin(p_size) as s, cos(p_size) as c, tan(p_size) as t, atan2(2,p_size) as a, asin(p_size/100.0::double) as x, acos(p_size/100.0::double) as y, degrees(p_size/10.0::double) as d, radians(p_size) as r, tanh(p_size/50.0::double) as h, pi()/2-atan(p_size) as k from part")
rows("bits", "part", {"a": "=BITAND([@p_partkey],[@p_size])", "o": "=BITOR([@p_partkey],[@p_size])", "x": "=BITXOR([@p_partkey],[@p_size])", "d": "=DELTA([@p_size],10)", "g": "=GESTEP([@p_size],25)"}, ["p_partkey"],
     "select p_partkey, (p_partkey & p_size)::double as a, (p_partkey | p_size)::double as o, xor(p_partkey, p_size::bigint)::double as x, (p_size=10)::int::double as d, (p_size>=25)::int::double as g from part")
rows("text_fns", "part", {"tag": '=UPPER(LEFT([@p_name],5))&"-"&LEN([@p_name])', "low": "=LOWER([@p_brand])", "r": "=RIGHT([@p_name],3)", "m": "=MID([@p_name],2,4)", "rp": '=REPLACE([@p_name],1,2,"__")', "sb": '=SUBSTITUTE([@p_name]," ","-")', "pr": "=PROPER([@p_name])", "f": '=IFERROR(FIND("e",[@p_name]),0)', "rt": '=REPT("*",MOD([@p_size],5))', "x": '=EXACT([@p_brand],UPPER([@p_brand]))', "cc": '=CONCATENATE([@p_brand],"/",[@p_size])', "j": '=TEXTJOIN("|",TRUE,[@p_brand],"",[@p_type])', "tb": '=TEXTBEFORE([@p_name]," ")', "ta": '=TEXTAFTER([@p_name]," ")', "tr": '=TRIM("  "&[@p_name]&"  ")'}, ["p_partkey"],
     "select p_partkey, upper(left(p_name,5))||'-'||length(p_name) as tag, lower(p_brand) as low, right(p_name,3) as r, substr(p_name,2,4) as m, '__'||substr(p_name,3) as rp, replace(p_name,' ','-') as sb, array_to_string(list_transform(string_split(p_name,' '), lambda w: upper(w[1])||lower(w[2:])),' ') as pr, instr(p_name,'e')::double as f, repeat('*',p_size%5) as rt, p_brand=upper(p_brand) as x, p_brand||'/'||p_size as cc, p_brand||'|'||p_type as j, string_split(p_name,' ')[1] as tb, substr(p_name,instr(p_name,' ')+1) as ta, trim(p_name) as tr from part")
rows("text_library", "part", {"tx": '=TEXT([@p_retailprice],"#,##0.00")', "rom": "=ROMAN(MOD([@p_size],4))", "hx": "=DEC2HEX([@p_partkey])", "b": "=BASE([@p_size],2)"}, ["p_partkey"],
     "select p_partkey, format('{:,.2f}', p_retailprice) as tx, ['','I','II','III'][p_size%4+1] as rom, upper(to_hex(p_partkey)) as hx, to_base(p_size,2) as b from part")
rows("date_fns", "orders", {"ym": "=YEAR([@o_orderdate])*100+MONTH([@o_orderdate])", "d": "=DAY([@o_orderdate])", "eom": "=EOMONTH([@o_orderdate],0)", "next": "=EDATE([@o_orderdate],1)", "wd": "=WEEKDAY([@o_orderdate],2)", "wn": "=ISOWEEKNUM([@o_orderdate])", "days": "=DAYS(DATE(2005,1,1),[@o_orderdate])", "m": '=DATEDIF([@o_orderdate],DATE(2010,6,15),"M")', "ser": "=INT([@o_orderdate]+0)"}, ["o_orderkey"],
     "select o_orderkey, (year(o_orderdate)*100+month(o_orderdate))::double as ym, day(o_orderdate)::double as d, last_day(o_orderdate::date) as eom, (o_orderdate::date + interval 1 month)::date as next, isodow(o_orderdate)::double as wd, week(o_orderdate)::double as wn, date_diff('day', o_orderdate::date, date '2005-01-01')::double as days, datesub('month', o_orderdate::date, date '2010-06-15')::double as m, date_diff('day', date '1899-12-30', o_orderdate::date)::double as ser from orders")
rows("time_fns", "events", {"h": "=HOUR([@ts])", "mi": "=MINUTE([@ts])", "s": "=SECOND([@ts])", "y": "=YEAR([@ts])"}, ["event_id"], "select event_id, hour(ts)::double as h, minute(ts)::double as mi, floor(second(ts))::double as s, year(ts)::double as y from events")
rows("networkdays", "orders", {"n": "=NETWORKDAYS([@o_orderdate],DATE(2003,3,31))"}, ["o_orderkey"],
     "select o_orderkey, (select count(*) from range(0, 7) t(i) where isodow(least(o_orderdate::date, date '2003-03-31') + t.i::int) < 6 and t.i < (abs(date_diff('day', o_orderdate::date, date '2003-03-31')) + 1) % 7)::double + floor((abs(date_diff('day', o_orderdate::date, date '2003-03-31')) + 1) / 7) * 5 as n from orders where o_orderdate::date <= date '2003-03-31' union all select o_orderkey, -((select count(*) from range(0, 7) t(i) where isodow(least(o_orderdate::date, date '2003-03-31') + t.i::int) < 6 and t.i < (abs(date_diff('day', o_orderdate::date, date '2003-03-31')) + 1) % 7)::double + floor((abs(date_diff('day', o_orderdate::date, date '2003-03-31')) + 1) / 7) * 5) from orders where o_orderdate::date > date '2003-03-31'")
rows("finance", "orders", {"pmt": "=PMT(0.05/12,60,-[@o_totalprice])", "fv": "=FV(0.04/12,24,-100,-[@o_totalprice])", "pv": "=PV(0.03,10,0,-[@o_totalprice])", "ip": "=IPMT(0.05/12,3,60,[@o_totalprice])", "pp": "=PPMT(0.05/12,3,60,[@o_totalprice])", "sln": "=SLN([@o_totalprice],1000,10)", "syd": "=SYD([@o_totalprice],1000,10,2)", "ef": "=EFFECT(0.05,12)"}, ["o_orderkey"],
     "select o_orderkey, o_totalprice*(0.05/12)/(1-pow(1+0.05/12,-60)) as pmt, o_totalprice*pow(1+0.04/12,24)+100*(pow(1+0.04/12,24)-1)/(0.04/12) as fv, o_totalprice/pow(1.03,10) as pv, -(o_totalprice*pow(1+0.05/12,2)-o_totalprice*(0.05/12)/(1-pow(1+0.05/12,-60))*(pow(1+0.05/12,2)-1)/(0.05/12))*0.05/12 as ip, -o_totalprice*(0.05/12)/(1-pow(1+0.05/12,-60))+(o_totalprice*pow(1+0.05/12,2)-o_totalprice*(0.05/12)/(1-pow(1+0.05/12,-60))*(pow(1+0.05/12,2)-1)/(0.05/12))*0.05/12 as pp, (o_totalprice-1000)/10 as sln, (o_totalprice-1000)*9*2/110 as syd, pow(1+0.05/12,12)-1 as ef from orders")
rows("let_lambda", "orders", {"x": "=LET(r,0.1,p,[@o_totalprice],p*(1+r))", "y": "=LAMBDA(a,b,a*b+1)([@o_orderkey],2)"}, ["o_orderkey"], "select o_orderkey, o_totalprice*(1+0.1::double) as x, o_orderkey*2.0::double+1 as y from orders")
rows("distributions", "part", {"n": "=NORM.DIST([@p_size],25,10,FALSE)", "z": "=NORM.S.DIST(NORM.S.INV(([@p_size]+1)/60),TRUE)", "t": "=T.DIST.2T([@p_size]/20,2)", "c": "=CHISQ.DIST.RT([@p_size],8)", "b": "=BINOM.DIST(MOD([@p_size],10),10,0.4,FALSE)", "bc": "=BINOM.DIST(MOD([@p_size],2),10,0.4,TRUE)", "k": "=F.DIST.RT([@p_size],2,6)", "g": "=GAMMALN([@p_size]+1)"}, ["p_partkey"],
     "with t as (select p_partkey, p_size, p_size::double as n from part) select p_partkey, exp(-pow((n-25)/10,2)/2)/(10*sqrt(2*pi())) as n, (n+1)/60 as z, 1-(n/20)/sqrt(2+pow(n/20,2)) as t, exp(-n/2)*(1+n/2+pow(n/2,2)/2+pow(n/2,3)/6) as c, (factorial(10)/(factorial(p_size%10)*factorial(10-p_size%10)))::double*pow(0.4::double,p_size%10)*pow(0.6::double,10-p_size%10) as b, pow(0.6::double,10)+(p_size%2)*4*pow(0.6::double,9) as bc, pow(1+n/3,-3) as k, lgamma(n+1) as g from t")
rows("yield_rate", "part", {"r": "=RATE(2,-55,[@p_retailprice]/10)", "y": "=PRICE(DATE(2024,3,1),DATE(2026,3,1),0.05,YIELD(DATE(2024,3,1),DATE(2026,3,1),0.05,90+MOD([@p_size],20),100,2),100,2)", "v": "=PV(RATE(48,-50,[@p_retailprice]),48,-50)"}, ["p_partkey"],
     "select p_partkey, (55+sqrt(55*55+22*p_retailprice))/(p_retailprice/5)-1 as r, (90+p_size%20)::double as y, p_retailprice as v from part")

rows("combinatorics", "part", {"p": "=PERMUT([@p_size]+3,2)", "ca": "=COMBINA([@p_size]+1,2)", "g": "=GCD([@p_partkey]+1,[@p_size]+1)", "l": "=LCM([@p_size]+1,6)", "fd": "=FACTDOUBLE(MOD([@p_size],4))", "ml": "=MULTINOMIAL(MOD([@p_size],4),2)", "ss": "=SERIESSUM([@p_size]/50,0,1,{1,2,3})", "sm": "=SUMSQ([@p_size],2)"}, ["p_partkey"],
     "select p_partkey, ((p_size+3)*(p_size+2))::double as p, ((p_size+2)*(p_size+1)/2)::double as ca, gcd(p_partkey+1,p_size+1)::double as g, lcm(p_size+1,6)::double as l, [1,1,2,3][p_size%4+1]::double as fd, [1,3,6,10][p_size%4+1]::double as ml, 1+2*(p_size/50.0::double)+3*pow(p_size/50.0::double,2) as ss, (p_size*p_size+4)::double as sm from part")
rows("hyperbolic", "part", {"a": "=SINH([@p_size]/20)", "b": "=COSH([@p_size]/20)", "c": "=ASINH([@p_size])", "d": "=ACOSH([@p_size]+1)", "e": "=ATANH([@p_size]/60)", "f": "=SECH([@p_size]/20)", "g": "=SEC([@p_size])", "h": "=CSC([@p_size]+1)", "i": "=COT([@p_size]+1)", "j": "=ACOTH([@p_size]+2)", "k": "=CSCH([@p_size]+1)", "l": "=COTH([@p_size]+1)", "m": "=FISHER([@p_size]/60)", "n": "=SQRTPI([@p_size])"}, ["p_partkey"],
     "select p_partkey, sinh(p_size/20.0::double) as a, cosh(p_size/20.0::double) as b, asinh(p_size::double) as c, acosh(p_size+1.0::double) as d, atanh(p_size/60.0::double) as e, 1/cosh(p_size/20.0::double) as f, 1/cos(p_size) as g, 1/sin(p_size+1) as h, 1/tan(p_size+1) as i, 0.5*ln((p_size+3.0::double)/(p_size+1.0::double)) as j, 1/sinh(p_size+1.0::double) as k, 1/tanh(p_size+1.0::double) as l, atanh(p_size/60.0::double) as m, sqrt(p_size*pi()) as n from part")
# ROMAN ends at 3999, keys do not: what is beyond is counted in steps of 4000
rows("engineering", "part", {"b": "=DEC2BIN([@p_size])", "o": "=DEC2OCT([@p_partkey])", "h": "=HEX2DEC(DEC2HEX([@p_partkey]))", "c": "=BIN2DEC(DEC2BIN([@p_size]))", "d": "=OCT2DEC(DEC2OCT([@p_size]))", "l": "=BITLSHIFT([@p_size],2)", "r": "=BITRSHIFT([@p_size],2)", "x": "=DECIMAL(BASE([@p_partkey],7),7)", "n": "=ARABIC(ROMAN(MOD([@p_partkey]+1,4000)))+4000*INT(([@p_partkey]+1)/4000)"}, ["p_partkey"],
     "select p_partkey, to_base(p_size,2) as b, to_base(p_partkey,8) as o, p_partkey::double as h, p_size::double as c, p_size::double as d, (p_size*4)::double as l, floor(p_size/4)::double as r, p_partkey::double as x, (p_partkey+1)::double as n from part")
rows("complex", "part", {"z": "=COMPLEX([@p_size]+1,2)", "a": "=IMABS(COMPLEX([@p_size],3))", "re": '=IMREAL(IMPRODUCT(COMPLEX([@p_size],2),"3+4i"))', "im": '=IMAGINARY(IMSUM(COMPLEX([@p_size],2),"1-5i"))', "cj": "=IMCONJUGATE(COMPLEX([@p_size]+2,3))", "ar": "=IMARGUMENT(COMPLEX([@p_size],1))"}, ["p_partkey"],
     "select p_partkey, (p_size+1)||'+2i' as z, sqrt(p_size*p_size+9) as a, (3*p_size-8)::double as re, -3.0::double as im, (p_size+2)||'-3i' as cj, atan2(1,p_size) as ar from part")
rows("units", "part", {"km": '=CONVERT([@p_size],"mi","km")', "f": '=CONVERT([@p_size],"C","F")', "lb": '=CONVERT([@p_size],"kg","lbm")', "h": '=CONVERT([@p_size],"day","hr")', "n": '=IFNA(CONVERT([@p_size],"kg","m"),-1)'}, ["p_partkey"],
     "select p_partkey, p_size*1.609344::double as km, p_size*9.0::double/5+32 as f, p_size*1000/453.59237::double as lb, p_size*24.0::double as h, -1.0::double as n from part")
rows("closed_distributions", "part", {"p": "=PHI([@p_size]/20)", "s": "=STANDARDIZE([@p_size],25,10)", "e": "=EXPON.DIST([@p_size],0.1,TRUE)", "w": "=WEIBULL.DIST([@p_size],2,30,FALSE)", "g": "=GAMMALN([@p_size]+1)", "po": "=POISSON.DIST(MOD([@p_size],8),3,FALSE)", "b": "=BINOM.DIST(MOD([@p_size],5),4,0.3,FALSE)", "h": "=HYPGEOM.DIST(MOD([@p_size],3),2,5,9,FALSE)", "nb": "=NEGBINOM.DIST(MOD([@p_size],6),1,0.25,FALSE)", "ln": "=LOGNORM.DIST(1,MOD([@p_size],1),1,TRUE)", "u": "=BETA.DIST([@p_size]/60,1,1,TRUE)", "x": "=CHISQ.DIST.RT([@p_size],2)", "f": "=FISHERINV([@p_size]/50)"}, ["p_partkey"],
     "select p_partkey, exp(-pow(p_size/20.0::double,2)/2)/sqrt(2*pi()) as p, (p_size-25)/10.0::double as s, 1-exp(-0.1::double*p_size) as e, 2/30.0::double*(p_size/30.0::double)*exp(-pow(p_size/30.0::double,2)) as w, lgamma(p_size+1) as g, pow(3,p_size%8)*exp(-3)/factorial(p_size%8) as po, [0.2401,0.4116,0.2646,0.0756,0.0081][p_size%5+1]::double as b, [6/36.0,20/36.0,10/36.0][p_size%3+1]::double as h, 0.25::double*pow(0.75,p_size%6) as nb, 0.5::double as ln, p_size/60.0::double as u, exp(-p_size/2.0::double) as x, tanh(p_size/50.0::double) as f from part")
rows("date_more", "orders", {"y": "=YEARFRAC([@o_orderdate],DATE(2010,1,1),3)", "d": "=DAYS360([@o_orderdate],DATE(2010,6,15),TRUE)", "w": "=WEEKDAY([@o_orderdate])", "dt": "=DATE(YEAR([@o_orderdate]),MONTH([@o_orderdate])+1,1)", "tm": "=TIME(1,MOD([@o_orderkey],60),30)", "wk": "=WEEKNUM([@o_orderdate],21)", "md": '=DATEDIF([@o_orderdate],DATE(2010,6,15),"D")', "tx": '=TEXT([@o_orderdate],"yyyy-mm-dd")', "dv": '=DATEVALUE("2001-02-03")'}, ["o_orderkey"],
     "select o_orderkey, abs(date_diff('day', o_orderdate::date, date '2010-01-01'))/365.0::double as y, ((2010-year(o_orderdate))*360+(6-month(o_orderdate))*30+15-least(day(o_orderdate),30))::double as d, (dayofweek(o_orderdate)+1)::double as w, (date_trunc('month',o_orderdate)+interval 1 month)::date as dt, (3600+60*(o_orderkey%60)+30)/86400.0::double as tm, week(o_orderdate)::double as wk, date_diff('day', o_orderdate::date, date '2010-06-15')::double as md, strftime(o_orderdate,'%Y-%m-%d') as tx, 36925.0::double as dv from orders")
rows("finance_more", "orders", {"n": "=NPER(0.01,-[@o_totalprice],[@o_totalprice]*20)", "r": "=RRI(5,1000,[@o_totalprice]+1)", "p": "=PDURATION(0.05,100,[@o_totalprice]+200)", "i": "=ISPMT(0.01,3,24,[@o_totalprice])", "no": "=NOMINAL(0.06,4)", "de": "=DOLLARDE(1.02,16)", "tb": "=TBILLPRICE(DATE(2024,1,1),DATE(2024,4,1),0.038)", "np": "=NPV(0.1,[@o_totalprice],100)", "dd": "=DDB([@o_totalprice]+10000,1000,10,1)", "pr": "=PPMT(0,1,10,[@o_totalprice])"}, ["o_orderkey"],
     "select o_orderkey, -ln(1-20*0.01::double)/ln(1.01::double) as n, pow((o_totalprice+1)/1000,0.2)-1 as r, (ln(o_totalprice+200)-ln(100))/ln(1.05::double) as p, o_totalprice*0.01*(3/24.0-1) as i, 4*(pow(1.06::double,0.25)-1) as no, 1.125::double as de, 100*(1-0.038*91/360::double) as tb, o_totalprice/1.1::double+100/1.21::double as np, (o_totalprice+10000)*0.2::double as dd, -o_totalprice/10 as pr from orders")
rows("text_more", "part", {"c": "=CHAR(65+MOD([@p_size],26))", "d": '=CODE([@p_name])', "v": '=VALUE("1"&[@p_size])', "nv": '=NUMBERVALUE([@p_size]&",5",",",".")', "cl": '=CLEAN([@p_name]&CHAR(9))', "fx": "=FIXED([@p_retailprice],1)", "dl": "=DOLLAR([@p_size])", "uc": "=UNICHAR(8364)", "un": "=UNICODE([@p_type])", "at": "=VALUETOTEXT([@p_name],1)", "ad": "=ADDRESS([@p_size]+1,2)", "sr": '=IFERROR(SEARCH("?o",[@p_name]),0)', "pc": '="5%"*[@p_size]'}, ["p_partkey"],
     "select p_partkey, chr(65+p_size%26) as c, ascii(p_name)::double as d, ('1'||p_size)::double as v, p_size+0.5::double as nv, p_name as cl, format('{:,.1f}', floor(p_retailprice*10+0.5)/10) as fx, '$'||p_size||'.00' as dl, '€' as uc, unicode(p_type)::double as un, '\"'||p_name||'\"' as at, '$B$'||(p_size+1) as ad, coalesce(nullif(instr(substr(p_name,2),'o'),0),0)::double as sr, p_size*0.05::double as pc from part")

# -- rows: functions against closed forms and series ----------------------------------------

rows("complex_more", "part", {"su": '=IMSUB(COMPLEX([@p_size]+1,2),"1-5i")', "dv": '=IMREAL(IMDIV(COMPLEX([@p_size],2),"1+i"))', "ex": "=IMREAL(IMEXP(COMPLEX([@p_size]/50,1)))", "ln": "=IMREAL(IMLN(COMPLEX([@p_size],3)))", "lg": "=IMREAL(IMLOG10(COMPLEX([@p_size],3)))", "l2": "=IMREAL(IMLOG2(COMPLEX([@p_size],3)))", "pw": "=IMREAL(IMPOWER(COMPLEX([@p_size],1),2))", "sq": "=IMREAL(IMSQRT(COMPLEX([@p_size],3)))", "si": "=IMREAL(IMSIN(COMPLEX([@p_size]/20,1)))", "co": "=IMREAL(IMCOS(COMPLEX([@p_size]/20,1)))", "ta": "=IMREAL(IMTAN(COMPLEX([@p_size]/20,1)))", "ct": "=IMREAL(IMCOT(COMPLEX([@p_size]/20,1)))", "cs": "=IMREAL(IMCSC(COMPLEX([@p_size]/20,1)))", "se": "=IMREAL(IMSEC(COMPLEX([@p_size]/20,1)))", "sh": "=IMREAL(IMSINH(COMPLEX([@p_size]/20,1)))", "ch": "=IMREAL(IMCOSH(COMPLEX([@p_size]/20,1)))", "sx": "=IMREAL(IMSECH(COMPLEX([@p_size]/20,1)))", "cx": "=IMREAL(IMCSCH(COMPLEX([@p_size]/20,1)))"}, ["p_partkey"],
     "with t as (select p_partkey, p_size::double as n, p_size/20.0::double as x from part) select p_partkey, n::bigint||'+7i' as su, (n+2)/2 as dv, exp(n/50)*cos(1) as ex, ln(n*n+9)/2 as ln, log10(n*n+9)/2 as lg, log2(n*n+9)/2 as l2, n*n-1 as pw, sqrt((sqrt(n*n+9)+n)/2) as sq, sin(x)*cosh(1) as si, cos(x)*cosh(1) as co, sin(2*x)/(cos(2*x)+cosh(2)) as ta, sin(2*x)/(cosh(2)-cos(2*x)) as ct, sin(x)*cosh(1)/(pow(sin(x),2)+pow(sinh(1),2)) as cs, cos(x)*cosh(1)/(pow(cos(x),2)+pow(sinh(1),2)) as se, sinh(x)*cos(1) as sh, cosh(x)*cos(1) as ch, cosh(x)*cos(1)/(pow(sinh(x),2)+pow(cos(1),2)) as sx, sinh(x)*cos(1)/(pow(sinh(x),2)+pow(sin(1),2)) as cx from t")
rows("inverse_distributions", "part", {"b": "=BETA.INV([@p_size]/60,1,1)", "bi": "=BETAINV([@p_size]/60,2,1)", "bn": "=BINOM.INV(1,0.4,[@p_size]/53)", "cb": "=CRITBINOM(1,0.4,[@p_size]/53)", "ci": "=CHISQ.INV([@p_size]/60,2)", "cr": "=CHISQ.INV.RT([@p_size]/60,2)", "cl": "=CHIINV([@p_size]/60,2)", "fi": "=F.INV([@p_size]/60,2,2)", "fr": "=F.INV.RT([@p_size]/60,2,2)", "fl": "=FINV([@p_size]/60,2,2)", "gi": "=GAMMA.INV([@p_size]/60,1,3)", "gl": "=GAMMAINV([@p_size]/60,1,3)", "li": "=LOGNORM.INV(0.975,[@p_size]/20,0.5)", "ll": "=LOGINV(0.025,[@p_size]/20,0.5)", "ni": "=NORM.INV(0.975,[@p_size],3)", "nl": "=NORMINV(0.025,[@p_size],3)", "ns": "=NORMSINV(0.975)*[@p_size]", "nz": "=NORM.S.INV(0.025)*[@p_size]", "ti": "=T.INV([@p_size]/60,1)", "t2": "=T.INV.2T([@p_size]/60,1)", "tl": "=TINV([@p_size]/60,1)"}, ["p_partkey"],
     "with t as (select p_partkey, p_size::double as n, p_size/60.0::double as p, 1.959963984540054::double as z from part) select p_partkey, p as b, sqrt(p) as bi, (n/53>0.6)::int::double as bn, (n/53>0.6)::int::double as cb, -2*ln(1-p) as ci, -2*ln(p) as cr, -2*ln(p) as cl, p/(1-p) as fi, (1-p)/p as fr, (1-p)/p as fl, -3*ln(1-p) as gi, -3*ln(1-p) as gl, exp(n/20+z/2) as li, exp(n/20-z/2) as ll, n+3*z as ni, n-3*z as nl, z*n as ns, -z*n as nz, case when n=30 then 0 else tan(pi()*(p-0.5)) end as ti, tan(pi()*(0.5-p/2)) as t2, tan(pi()*(0.5-p/2)) as tl from t", ti="double")
rows("distribution_tails", "part", {"ch": "=CHISQ.DIST([@p_size],2,TRUE)", "cd": "=CHIDIST([@p_size],2)", "br": "=BINOM.DIST.RANGE(4,0.3,MOD([@p_size],5))", "bl": "=BINOMDIST(MOD([@p_size],5),4,0.3,FALSE)", "el": "=EXPONDIST([@p_size],0.1,TRUE)", "fd": "=F.DIST([@p_size],2,2,TRUE)", "fr": "=F.DIST.RT([@p_size],2,2)", "fl": "=FDIST([@p_size],2,2)", "ga": "=GAMMA(MOD([@p_size],9)+1)", "gd": "=GAMMA.DIST([@p_size],1,9,TRUE)", "gl": "=GAMMADIST([@p_size],1,9,FALSE)", "gp": "=GAMMALN.PRECISE([@p_size]+1)", "td": "=T.DIST([@p_size]/10,1,TRUE)", "tr": "=T.DIST.RT([@p_size]/10,1)", "t2": "=T.DIST.2T([@p_size]/10,1)", "po": "=POISSON(MOD([@p_size],8),3,FALSE)", "we": "=WEIBULL([@p_size],2,30,TRUE)", "cn": "=CONFIDENCE.NORM(0.05,[@p_size],16)", "cl": "=CONFIDENCE(0.05,[@p_size],16)", "ct": "=CONFIDENCE.T(0.5,[@p_size],2)"}, ["p_partkey"],
     "with t as (select p_partkey, p_size, p_size::double as n from part) select p_partkey, 1-exp(-n/2) as ch, exp(-n/2) as cd, [0.2401,0.4116,0.2646,0.0756,0.0081][p_size%5+1]::double as br, [0.2401,0.4116,0.2646,0.0756,0.0081][p_size%5+1]::double as bl, 1-exp(-n/10) as el, n/(1+n) as fd, 1/(1+n) as fr, 1/(1+n) as fl, factorial(p_size%9)::double as ga, 1-exp(-n/9) as gd, exp(-n/9)/9 as gl, lgamma(n+1) as gp, 0.5+atan(n/10)/pi() as td, 0.5-atan(n/10)/pi() as tr, 1-2*atan(n/10)/pi() as t2, pow(3,p_size%8)*exp(-3)/factorial(p_size%8) as po, 1-exp(-pow(n/30,2)) as we, 1.959963984540054*n/4 as cn, 1.959963984540054*n/4 as cl, n/sqrt(2) as ct from t")
rows("error_function", "part", {"e": "=ERF([@p_size]/50)", "p": "=ERF.PRECISE([@p_size]/50)", "c": "=ERFC([@p_size]/50)", "q": "=ERFC.PRECISE([@p_size]/50)", "nd": "=NORM.DIST([@p_size],0,50/SQRT(2),TRUE)", "nl": "=NORMDIST([@p_size],0,50/SQRT(2),TRUE)", "ns": "=NORM.S.DIST([@p_size]/50*SQRT(2),TRUE)", "nz": "=NORMSDIST([@p_size]/50*SQRT(2))", "g": "=GAUSS([@p_size]/50*SQRT(2))"}, ["p_partkey"],
     "with t as (select p_partkey, 2/sqrt(pi())*list_sum(list_transform(range(0,28), lambda k: pow(-1.0,k)*pow(p_size/50.0::double,2*k+1)/(factorial(k::int)::double*(2*k+1)))) as y from part) select p_partkey, y as e, y as p, 1-y as c, 1-y as q, 0.5+y/2 as nd, 0.5+y/2 as nl, 0.5+y/2 as ns, 0.5+y/2 as nz, y/2 as g from t")
rows("bessel", "part", {"j": "=BESSELJ([@p_size]/10,1)", "i": "=BESSELI([@p_size]/10,1)", "k": "=BESSELK([@p_size]/10,1)", "y": "=BESSELY([@p_size]/10,0)"}, ["p_partkey"],
     "with t as (select p_partkey, p_size/10.0::double as x from part), u as (select *, list_sum(list_transform(range(0,30), lambda k: pow(-1.0,k)*pow(x/2,2*k)/pow(factorial(k::int)::double,2))) as j0 from t) select p_partkey, list_sum(list_transform(range(0,30), lambda k: pow(-1.0,k)*pow(x/2,2*k+1)/(factorial(k::int)::double*factorial((k+1)::int)::double))) as j, list_sum(list_transform(range(0,30), lambda k: pow(x/2,2*k+1)/(factorial(k::int)::double*factorial((k+1)::int)::double))) as i, 0.05*(exp(-x)/2+list_sum(list_transform(range(1,200), lambda k: exp(-x*cosh(k*0.05::double))*cosh(k*0.05::double)))) as k, 2/pi()*((ln(x/2)+0.5772156649015329)*j0+list_sum(list_transform(range(1,30), lambda k: -pow(-1.0,k)*list_sum(list_transform(range(1,k+1), lambda h: 1.0::double/h))*pow(x/2,2*k)/pow(factorial(k::int)::double,2)))) as y from u")
rows("bonds", "part", {"pr": "=PRICE(DATE(2024,3,1),DATE(2026,3,1),0.05,[@p_size]/500,100,2)", "yl": "=YIELD(DATE(2024,3,1),DATE(2026,3,1),0.05+[@p_size]/1000,100,100,2)", "te": "=TBILLEQ(DATE(2024,1,1),DATE(2024,4,1),[@p_size]/1000)", "ty": "=TBILLYIELD(DATE(2024,1,1),DATE(2024,4,1),95+[@p_size]/20)", "df": "=DOLLARFR([@p_size]+0.125,16)", "ra": "=RATE(2,0,-100,121+[@p_size])", "ir": "=IRR({-100,60,60},[@p_size]/100)", "mi": "=MIRR({-100,60,70},0.1,[@p_size]/100)", "xi": "=XIRR({-100,110},{36526,36891},[@p_size]/100)"}, ["p_partkey"],
     "with t as (select p_partkey, p_size::double as n, 1+p_size/1000.0::double as y from part) select p_partkey, 2.5/y+2.5/pow(y,2)+2.5/pow(y,3)+102.5/pow(y,4) as pr, 0.05+n/1000 as yl, 365*n/1000/(360-n/1000*91) as te, (5-n/20)/(95+n/20)*360/91 as ty, n+0.02 as df, sqrt((121+n)/100)-1 as ra, 0.3+sqrt(0.69::double)-1 as ir, sqrt((60*(1+n/100)+70)/100)-1 as mi, 0.1::double as xi from t")
rows("loans", "part", {"am": "=ACCRINTM(DATE(2000,1,1)+[@p_size],DATE(2010,1,1),0.05,1000,3)", "ac": "=ACCRINT(DATE(2008,3,1),DATE(2008,8,31),DATE(2008,5,1),0.1,[@p_retailprice],2,0)", "ci": "=CUMIPMT(0.05/12,60,[@p_retailprice],1,60,0)", "cp": "=CUMPRINC(0.05/12,60,[@p_retailprice],1,60,0)", "db": "=DB(SQRT([@p_retailprice])*300,1000,10,1,12)"}, ["p_partkey"],
     "select p_partkey, 50.0::double*(date_diff('day', date '2000-01-01', date '2010-01-01')-p_size)/365 as am, p_retailprice/60 as ac, p_retailprice-60*p_retailprice*(0.05::double/12)/(1-pow(1+0.05::double/12,-60)) as ci, -p_retailprice as cp, sqrt(p_retailprice)*300*round(1-pow(1000/(sqrt(p_retailprice)*300),0.1::double),3) as db from part")
rows("workdays", "orders", {"w": "=WORKDAY([@o_orderdate],10)", "wi": "=WORKDAY.INTL([@o_orderdate],6,11)", "ni": "=NETWORKDAYS.INTL([@o_orderdate],[@o_orderdate]+MOD([@o_orderkey],7),11)", "t0": "=TODAY()-TODAY()", "no": "=NOW()>[@o_orderdate]", "tv": '=TIMEVALUE("06:00")'}, ["o_orderkey"],
     "select o_orderkey, (date_diff('day', date '1899-12-30', o_orderdate::date)+14-greatest(isodow(o_orderdate)-5,0))::double as w, (date_diff('day', date '1899-12-30', o_orderdate::date)+7-(isodow(o_orderdate)=7)::int)::double as wi, (o_orderkey%7+1-(isodow(o_orderdate)+o_orderkey%7>=7)::int)::double as ni, 0.0::double as t0, true as no, 0.25::double as tv from orders")
rows("text_bytes", "part", {"l": "=LEFTB([@p_name],3)", "r": "=RIGHTB([@p_name],3)", "m": "=MIDB([@p_name],2,3)", "n": "=LENB([@p_name])", "rp": '=REPLACEB([@p_name],1,2,"_")', "f": '=IFERROR(FINDB("e",[@p_name]),0)', "s": '=IFERROR(SEARCHB("E",[@p_name]),0)', "a": "=ASC([@p_name])", "t": "=T([@p_name])", "cc": '=CONCAT([@p_name],"-",[@p_size])', "at": "=ARRAYTOTEXT({1,2,3})", "hl": '=HLOOKUP(MOD([@p_size],3)+1,{1,2,3;"a","b","c"},2,FALSE)', "bh": "=BIN2HEX(DEC2BIN([@p_size]))", "bo": "=BIN2OCT(DEC2BIN([@p_size]))", "hb": "=HEX2BIN(DEC2HEX([@p_size]))", "ho": "=HEX2OCT(DEC2HEX([@p_partkey]))", "ob": "=OCT2BIN(DEC2OCT([@p_size]))", "oh": "=OCT2HEX(DEC2OCT([@p_partkey]))", "tf": "=AND(TRUE(),NOT(FALSE()))", "rb": "=RANDBETWEEN([@p_size],[@p_size])", "rn": "=RAND()<1"}, ["p_partkey"],
     "select p_partkey, left(p_name,3) as l, right(p_name,3) as r, substr(p_name,2,3) as m, length(p_name)::double as n, '_'||substr(p_name,3) as rp, instr(p_name,'e')::double as f, instr(p_name,'e')::double as s, p_name as a, p_name as t, p_name||'-'||p_size as cc, '1, 2, 3' as at, ['a','b','c'][p_size%3+1] as hl, upper(to_hex(p_size)) as bh, to_base(p_size,8) as bo, to_base(p_size,2) as hb, to_base(p_partkey,8) as ho, to_base(p_size,2) as ob, upper(to_hex(p_partkey)) as oh, true as tf, p_size::double as rb, true as rn from part")
rows("rank_legacy", "customer", {"r": "=RANK([@c_acctbal],customer[c_acctbal])", "u": "=RANK([@c_acctbal],customer[c_acctbal],1)"}, ["c_custkey"],
     "select c_custkey, rank() over (order by c_acctbal desc)::double as r, rank() over (order by c_acctbal)::double as u from customer")
scalars("database_more", {"c": '=DCOUNTA(orders[#All],"o_orderpriority",{"o_orderstatus";"O"})', "m": '=DMIN(orders[#All],"o_totalprice",{"o_orderstatus";"P"})', "p": '=DPRODUCT(orders[#All],"o_orderkey",{"o_orderkey","o_orderkey";">0","<7"})', "sp": '=DSTDEVP(orders[#All],"o_totalprice",{"o_orderstatus";"F"})', "v": '=DVAR(orders[#All],"o_custkey",{"o_orderstatus";"F"})', "vp": '=DVARP(orders[#All],"o_orderkey",{"o_orderkey";"<100"})'}, ("orders",),
        "select (select count(o_orderpriority)::double from orders where o_orderstatus='O') as c, (select min(o_totalprice) from orders where o_orderstatus='P') as m, (select product(o_orderkey)::double from orders where o_orderkey>0 and o_orderkey<7) as p, (select round(stddev_pop(o_totalprice),4) from orders where o_orderstatus='F') as sp, (select round(var_samp(o_custkey),4) from orders where o_orderstatus='F') as v, (select round(var_pop(o_orderkey),4) from orders where o_orderkey<100) as vp", 4)
scalars("legacy_statistics", {"sd": "=STDEV(orders[o_totalprice])", "sp": "=STDEVP(orders[o_totalprice])", "va": "=VAR(lineitem[l_quantity])", "vp": "=VARP(lineitem[l_quantity])", "mo": "=MODE(orders[o_orderdate])", "q": "=QUARTILE(orders[o_totalprice],3)", "pe": "=PERCENTILE(orders[o_totalprice],0.35)", "co": "=COVAR(lineitem[l_discount],lineitem[l_tax])", "fc": "=FORECAST(10,lineitem[l_extendedprice],lineitem[l_quantity])", "pr": "=PRODUCT(nation[n_regionkey])", "sk": "=SKEW.P(orders[o_totalprice])"}, ("orders", "lineitem", "nation"),
        "select round(stddev_samp(o_totalprice),4) as sd, round(stddev_pop(o_totalprice),4) as sp, (select round(var_samp(l_quantity),4) from lineitem) as va, (select round(var_pop(l_quantity),4) from lineitem) as vp, (select date_diff('day', date '1899-12-30', o_orderdate::date)::double from orders group by o_orderdate order by count(*) desc, min(o_orderkey) limit 1) as mo, round(quantile_cont(o_totalprice,0.75),4) as q, round(quantile_cont(o_totalprice,0.35),4) as pe, (select round(covar_pop(l_discount,l_tax),4) from lineitem) as co, (select round(regr_intercept(l_extendedprice,l_quantity)+10*regr_slope(l_extendedprice,l_quantity),4) from lineitem) as fc, (select product(n_regionkey)::double from nation) as pr, round((sum(pow(o_totalprice-m,3))/count(*))/pow(stddev_pop(o_totalprice),3),4) as sk from orders, (select avg(o_totalprice) as m from orders)", 4)

# -- scalars --------------------------------------------------------------------------------

scalars("sum_scalar", {"total": "=SUM(lineitem[l_quantity])"}, ("lineitem",), "select sum(l_quantity) as total from lineitem")
scalars("core_aggregates", {"s": "=SUM(lineitem[l_quantity])", "c": "=COUNT(lineitem[l_quantity])", "a": "=AVERAGE(lineitem[l_quantity])", "lo": "=MIN(lineitem[l_extendedprice])", "hi": "=MAX(lineitem[l_extendedprice])", "ca": "=COUNTA(lineitem[l_returnflag])", "cb": "=COUNTBLANK(lineitem[l_returnflag])", "sq": "=SUMSQ(lineitem[l_discount])", "txt": "=SUM(lineitem[l_returnflag])"}, ("lineitem",),
        "select sum(l_quantity)::double as s, count(l_quantity)::double as c, round(avg(l_quantity),6) as a, min(l_extendedprice) as lo, max(l_extendedprice) as hi, count(l_returnflag)::double as ca, (count(*)-count(l_returnflag))::double as cb, round(sum(l_discount*l_discount),6) as sq, 0.0::double as txt from lineitem", 6)
scalars("sumifs_literal", {"q": '=SUMIFS(lineitem[l_quantity],lineitem[l_returnflag],"r",lineitem[l_discount],">=0.05")'}, ("lineitem",), "select coalesce(sum(l_quantity) filter (where lower(l_returnflag)='r' and l_discount>=0.05),0) as q from lineitem")
scalars("criteria_family", {"ci": '=COUNTIF(orders[o_orderpriority],"1*")', "si": '=SUMIF(orders[o_totalprice],">100000")', "ai": '=AVERAGEIF(orders[o_orderstatus],"f",orders[o_totalprice])', "cs": '=COUNTIFS(orders[o_orderstatus],"<>O",orders[o_totalprice],"<=200000")', "as_": '=AVERAGEIFS(orders[o_totalprice],orders[o_orderstatus],"O",orders[o_orderpriority],"?-HIGH")', "mx": '=MAXIFS(orders[o_totalprice],orders[o_orderstatus],"P")', "mn": '=MINIFS(orders[o_totalprice],orders[o_orderstatus],"P",orders[o_totalprice],">5000")', "d": '=COUNTIF(orders[o_orderdate],">=1/1/2000")'}, ("orders",),
        "select count(*) filter (where o_orderpriority like '1%')::double as ci, round(sum(o_totalprice) filter (where o_totalprice>100000),4) as si, round(avg(o_totalprice) filter (where o_orderstatus='F'),4) as ai, count(*) filter (where o_orderstatus<>'O' and o_totalprice<=200000)::double as cs, round(avg(o_totalprice) filter (where o_orderstatus='O' and o_orderpriority like '_-HIGH'),4) as as_, max(o_totalprice) filter (where o_orderstatus='P') as mx, min(o_totalprice) filter (where o_orderstatus='P' and o_totalprice>5000) as mn, count(*) filter (where o_orderdate >= date '2000-01-01')::double as d from orders", 4)
scalars("countif_wildcard", {"n": '=COUNTIF(part[p_type],"*a*")'}, ("part",), "select count(*) filter (where lower(p_type) like '%a%')::double as n from part")
scalars("sumproduct", {"v": "=SUMPRODUCT(lineitem[l_extendedprice],1-lineitem[l_discount])", "w": '=SUMPRODUCT((lineitem[l_quantity]>25)*(lineitem[l_returnflag]="R"),lineitem[l_extendedprice])'}, ("lineitem",),
        "select round(sum(l_extendedprice*(1-l_discount)),2) as v, round(sum(l_extendedprice) filter (where l_quantity>25 and l_returnflag='R'),2) as w from lineitem", 2)
scalars("percentile", {"p90": "=PERCENTILE.INC(lineitem[l_extendedprice],0.9)", "med": "=MEDIAN(lineitem[l_extendedprice])", "q1": "=QUARTILE.INC(lineitem[l_extendedprice],1)", "l3": "=LARGE(lineitem[l_extendedprice],3)", "s3": "=SMALL(lineitem[l_extendedprice],3)"}, ("lineitem",),
        "select round(quantile_cont(l_extendedprice,0.9),4) as p90, round(median(l_extendedprice),4) as med, round(quantile_cont(l_extendedprice,0.25),4) as q1, (select l_extendedprice from lineitem order by 1 desc limit 1 offset 2) as l3, (select l_extendedprice from lineitem order by 1 limit 1 offset 2) as s3 from lineitem", 4)
scalars("percentile_exc", {"p": "=PERCENTILE.EXC(orders[o_totalprice],0.3)", "q": "=QUARTILE.EXC(orders[o_totalprice],3)", "t": "=TRIMMEAN(orders[o_totalprice],0.2)", "ad": "=AVEDEV(orders[o_totalprice])"}, ("orders",),
        "with s as (select o_totalprice v, row_number() over (order by o_totalprice) r, count(*) over () n from orders), p as (select max(n) n, 0.3*(max(n)+1) a, 0.75*(max(n)+1) b, floor(max(n)*0.1) g from s) select round((select v from s where r=floor(a))+(a-floor(a))*((select v from s where r=floor(a)+1)-(select v from s where r=floor(a))),3) as p, round((select v from s where r=floor(b))+(b-floor(b))*((select v from s where r=floor(b)+1)-(select v from s where r=floor(b))),3) as q, (select round(avg(v),3) from s where r>g and r<=n-g) as t, (select round(avg(abs(o_totalprice-m)),3) from orders, (select avg(o_totalprice) m from orders)) as ad from p", 3)
scalars("regression", {"slope": "=SLOPE(lineitem[l_extendedprice],lineitem[l_quantity])", "icept": "=INTERCEPT(lineitem[l_extendedprice],lineitem[l_quantity])", "r2": "=RSQ(lineitem[l_extendedprice],lineitem[l_quantity])", "cor": "=CORREL(lineitem[l_extendedprice],lineitem[l_quantity])", "cov": "=COVARIANCE.P(lineitem[l_discount],lineitem[l_tax])", "fc": "=FORECAST.LINEAR(10,lineitem[l_extendedprice],lineitem[l_quantity])"}, ("lineitem",),
        "select round(regr_slope(l_extendedprice,l_quantity),5) as slope, round(regr_intercept(l_extendedprice,l_quantity),5) as icept, round(regr_r2(l_extendedprice,l_quantity),5) as r2, round(corr(l_extendedprice,l_quantity),5) as cor, round(covar_pop(l_discount,l_tax),5) as cov, round(regr_intercept(l_extendedprice,l_quantity)+10*regr_slope(l_extendedprice,l_quantity),5) as fc from lineitem", 5)
scalars("stdev", {"sd": "=STDEV.S(lineitem[l_quantity])", "vp": "=VAR.P(lineitem[l_quantity])", "sp": "=STDEV.P(lineitem[l_quantity])", "vs": "=VAR.S(lineitem[l_quantity])", "dv": "=DEVSQ(lineitem[l_discount])", "gm": "=GEOMEAN(lineitem[l_quantity])", "hm": "=HARMEAN(lineitem[l_quantity])"}, ("lineitem",),
        "select round(stddev_samp(l_quantity),5) as sd, round(var_pop(l_quantity),5) as vp, round(stddev_pop(l_quantity),5) as sp, round(var_samp(l_quantity),5) as vs, round(var_pop(l_discount)*count(*),5) as dv, round(exp(avg(ln(l_quantity))),5) as gm, round(count(*)/sum(1/l_quantity),5) as hm from lineitem", 5)
scalars("moments", {"sk": "=SKEW(orders[o_totalprice])", "ku": "=KURT(orders[o_totalprice])", "sx": "=STEYX(lineitem[l_extendedprice],lineitem[l_quantity])"}, ("orders", "lineitem"),
        "select round(skewness(o_totalprice),4) as sk, round(kurtosis(o_totalprice),4) as ku, (select round(sqrt((regr_syy(l_extendedprice,l_quantity)-pow(regr_sxy(l_extendedprice,l_quantity),2)/regr_sxx(l_extendedprice,l_quantity))/(count(*)-2)),4) from lineitem) as sx from orders", 4)
scalars("mode", {"m": "=MODE.SNGL(lineitem[l_quantity])"}, ("lineitem",), "select l_quantity as m from lineitem group by 1 order by count(*) desc, 1 limit 1")
scalars("a_variants", {"a": "=AVERAGEA(part[p_size])", "x": "=MAXA(part[p_name])", "n": "=MINA(part[p_size])", "s": "=STDEVA(part[p_size])"}, ("part",), "select round(avg(p_size),5) as a, 0.0::double as x, min(p_size)::double as n, round(stddev_samp(p_size),5) as s from part", 5)
scalars("subtotal", {"s": "=SUBTOTAL(9,orders[o_totalprice])", "a": "=SUBTOTAL(101,orders[o_totalprice])", "g": "=AGGREGATE(4,2,orders[o_totalprice])"}, ("orders",), "select round(sum(o_totalprice),2) as s, round(avg(o_totalprice),2) as a, max(o_totalprice) as g from orders", 2)
scalars("database", {"s": '=DSUM(orders[#All],"o_totalprice",{"o_orderstatus","o_totalprice";"F",">100000";"P",""})', "c": '=DCOUNT(orders[#All],"o_totalprice",{"o_orderstatus";"O"})', "a": '=DAVERAGE(orders[#All],"o_totalprice",{"o_orderpriority";"1-URGENT"})', "m": '=DMAX(orders[#All],"o_totalprice",{"o_orderstatus";"P"})', "g": '=DGET(orders[#All],"o_totalprice",{"o_orderkey";7})', "v": '=DSTDEV(orders[#All],"o_totalprice",{"o_orderstatus";"F"})'}, ("orders",),
        "select round(sum(o_totalprice) filter (where (o_orderstatus='F' and o_totalprice>100000) or o_orderstatus='P'),3) as s, count(*) filter (where o_orderstatus='O')::double as c, round(avg(o_totalprice) filter (where o_orderpriority='1-URGENT'),3) as a, max(o_totalprice) filter (where o_orderstatus='P') as m, max(o_totalprice) filter (where o_orderkey=7) as g, round(stddev_samp(o_totalprice) filter (where o_orderstatus='F'),3) as v from orders", 3)
scalars("npv", {"n": "=NPV(0.0001,events[value])", "x": "=XNPV(0.1,orders[o_totalprice],orders[o_orderkey])"}, ("events", "orders"),
        "select round(sum(value/pow(1.0001,r)),3) as n, (select round(sum(o_totalprice/pow(1.1,(o_orderkey-(select min(o_orderkey) from orders))/365.0)),3) from orders) as x from (select value, row_number() over (order by event_id) r from events)", 3)
scalars("z_test", {"z": "=Z.TEST(lineitem[l_quantity],25.5)", "l": "=ZTEST(lineitem[l_quantity],25.4)", "s": "=Z.TEST(lineitem[l_quantity],25.6,14)"}, ("lineitem",),
        "with m as (select avg(l_quantity) as a, stddev_samp(l_quantity) as sd, sqrt(count(*)) as r from lineitem), t as (select unnest([(a-25.5)/(sd/r),(a-25.4)/(sd/r),(a-25.6)/(14/r)]) as z, unnest([1,2,3]) as i from m), p as (select i, round(0.5-z/1200/sqrt(2*pi())*list_sum(list_transform(range(0,401), lambda k: (case when k=0 or k=400 then 1 when k%2=1 then 4 else 2 end)*exp(-pow(k*z/400,2)/2))),6) as v from t) select max(v) filter (where i=1) as z, max(v) filter (where i=2) as l, max(v) filter (where i=3) as s from p", 6)
scalars("tests", {"z": "=Z.TEST(lineitem[l_quantity],25)", "t": "=T.TEST(lineitem[l_discount],lineitem[l_tax],2,3)", "f": "=F.TEST(lineitem[l_discount],lineitem[l_tax])"}, ("lineitem",), None)
scalars("textjoin_column", {"j": '=TEXTJOIN(",",TRUE,nation[n_name])'}, ("nation",), "select string_agg(n_name, ',' order by n_nationkey) as j from nation")

# -- lookups --------------------------------------------------------------------------------

rows("xlookup_exact", "orders", {"cust": '=XLOOKUP([@o_custkey],customer[c_custkey],customer[c_name],"none")', "bal": "=XLOOKUP([@o_custkey],customer[c_custkey],customer[c_acctbal])"}, ["o_orderkey"], "select o_orderkey, coalesce(c_name,'none') as cust, c_acctbal as bal from orders left join customer on o_custkey=c_custkey", more=("customer",))
rows("vlookup_exact", "orders", {"seg": "=VLOOKUP([@o_custkey],customer[[c_custkey]:[c_mktsegment]],5,FALSE)"}, ["o_orderkey"], "select o_orderkey, c_mktsegment as seg from orders left join customer on o_custkey=c_custkey", more=("customer",))
rows("index_match", "lineitem", {"p": "=INDEX(part[p_name],MATCH([@l_partkey],part[p_partkey],0))", "at": "=MATCH([@l_partkey],part[p_partkey],0)"}, ["l_orderkey", "l_linenumber", "l_partkey"], "select l_orderkey, l_linenumber, l_partkey, p_name as p, r::double as at from lineitem left join (select *, row_number() over (order by p_partkey) r from part) on l_partkey=p_partkey", more=("part",))
rows("lookup_missing", "events", {"n": '=XLOOKUP([@event_type],{"view","purchase"},{1,2},0)', "c": '=IFNA(XLOOKUP([@user_id],customer[c_custkey],customer[c_name]),"unknown")'}, ["event_id"], "select event_id, case event_type when 'view' then 1.0 when 'purchase' then 2.0 else 0.0 end as n, coalesce(c_name,'unknown') as c from events left join customer on user_id=c_custkey", more=("customer",))
rows("xlookup_last", "customer", {"last": "=XLOOKUP([@c_custkey],orders[o_custkey],orders[o_orderkey],-1,0,-1)", "first": "=XLOOKUP([@c_custkey],orders[o_custkey],orders[o_orderkey],-1)"}, ["c_custkey"], "select c_custkey, coalesce(max(o_orderkey),-1)::double as last, coalesce(min(o_orderkey),-1)::double as first from customer left join orders on o_custkey=c_custkey group by 1", more=("orders",))
rows("approx_match", "orders", {"band": '=XLOOKUP([@o_totalprice],{0,50000,150000},{"low","mid","high"},,-1)', "v": '=VLOOKUP([@o_totalprice],{0,"a";100000,"b";300000,"c"},2,TRUE)'}, ["o_orderkey"], "select o_orderkey, case when o_totalprice>=150000 then 'high' when o_totalprice>=50000 then 'mid' else 'low' end as band, case when o_totalprice>=300000 then 'c' when o_totalprice>=100000 then 'b' else 'a' end as v from orders")
rows("asof_lookup", "customer", {"s": "=IFNA(XLOOKUP([@c_acctbal],supplier[s_acctbal],supplier[s_acctbal],,-1),-99999)", "l": "=IFNA(XLOOKUP([@c_acctbal],supplier[s_acctbal],supplier[s_acctbal],,1),99999)"}, ["c_custkey"],
     "select c_custkey, coalesce((select max(s_acctbal) from supplier where s_acctbal<=c_acctbal),-99999) as s, coalesce((select min(s_acctbal) from supplier where s_acctbal>=c_acctbal),99999) as l from customer", more=("supplier",))
rows("wildcard_lookup", "nation", {"c": '=XLOOKUP([@n_name]&"*",nation[n_name],nation[n_nationkey],-1,2)'}, ["n_nationkey"], "select n_nationkey, (select m.n_nationkey::double from nation m where m.n_name like n.n_name||'%' order by m.n_nationkey limit 1) as c from nation n")
spill("semi_match", "=FILTER(customer[c_custkey],ISNUMBER(MATCH(customer[c_custkey],orders[o_custkey],0)))", ("customer", "orders"), "select c_custkey from customer where c_custkey in (select o_custkey from orders)")

spill("countif_semi", "=FILTER(part[p_partkey],COUNTIF(lineitem[l_partkey],part[p_partkey])>0)", ("part", "lineitem"), "select p_partkey from part where p_partkey in (select l_partkey from lineitem)")
spill("index_row", "=INDEX(customer[[c_custkey]:[c_name]],7,0)", ("customer",), "select c_custkey, c_name from customer order by c_custkey limit 1 offset 6")
spill("xlookup_row", '=XLOOKUP("nation_7",nation[n_name],nation[[n_nationkey]:[n_regionkey]])', ("nation",), "select n_nationkey, n_name, n_regionkey from nation where lower(n_name)='nation_7'")
rows("references", "part", {"c": "=COLUMN(part[p_brand])", "n": "=COLUMNS(part[[p_name]:[p_size]])", "r": "=ROWS(part)", "s": "=ISREF(part[p_size])", "i": '=INDIRECT("[@p_size]")*2', "x": "=INDEX(part[p_name],3)", "w": "=ROW()"}, ["p_partkey"],
     "select p_partkey, 3.0::double as c, 4.0::double as n, (select count(*) from part)::double as r, true as s, p_size*2.0::double as i, (select p_name from part order by p_partkey limit 1 offset 2) as x, (row_number() over (order by p_partkey))::double as w from part")


def _big(b: Book) -> None:
    b.table("big", b.frame("orders").where("o_orderstatus='P' and o_totalprice>400000"), ["o_orderkey"])


spill("anti_match", "=FILTER(customer[c_custkey],ISNA(MATCH(customer[c_custkey],orders[o_custkey],0)))", ("customer", "orders"), "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")

scalars("more_reductions", {"va": "=VARA(part[p_size])", "vpa": "=VARPA(part[p_size])", "spa": "=STDEVPA(part[p_size])", "cs": "=COVARIANCE.S(lineitem[l_discount],lineitem[l_tax])", "pe": "=PEARSON(lineitem[l_extendedprice],lineitem[l_quantity])", "d": "=SUMX2MY2(lineitem[l_quantity],lineitem[l_tax])", "p": "=SUMX2PY2(lineitem[l_quantity],lineitem[l_tax])", "x": "=SUMXMY2(lineitem[l_quantity],lineitem[l_tax])"}, ("part", "lineitem"),
        "select round(var_samp(p_size),4) as va, round(var_pop(p_size),4) as vpa, round(stddev_pop(p_size),4) as spa, (select round(covar_samp(l_discount,l_tax),4) from lineitem) as cs, (select round(corr(l_extendedprice,l_quantity),4) from lineitem) as pe, (select round(sum(l_quantity*l_quantity-l_tax*l_tax),4) from lineitem) as d, (select round(sum(l_quantity*l_quantity+l_tax*l_tax),4) from lineitem) as p, (select round(sum((l_quantity-l_tax)*(l_quantity-l_tax)),4) from lineitem) as x from part", 4)
rows("more_rounding", "part", {"cm": "=CEILING.MATH([@p_retailprice],7)", "fm": "=FLOOR.MATH([@p_retailprice],7)", "cp": "=CEILING.PRECISE([@p_retailprice]-1200,5)", "fp": "=FLOOR.PRECISE([@p_retailprice]-1200,5)", "ic": "=ISO.CEILING([@p_retailprice],3)", "at": "=ROUND(ATAN([@p_size]/10),8)", "pi": "=ROUND(PI()*[@p_size],6)", "lg": "=IF(ISLOGICAL([@p_size]>10),1,0)", "nt": "=IF(ISNONTEXT([@p_name]),1,0)", "er": "=IF(ISERR(1/([@p_size]-10)),1,0)"}, ["p_partkey"],
     "select p_partkey, ceil(p_retailprice/7)*7 as cm, floor(p_retailprice/7)*7 as fm, ceil((p_retailprice-1200)/5)*5 as cp, floor((p_retailprice-1200)/5)*5 as fp, ceil(p_retailprice/3)*3 as ic, round(atan(p_size/10.0),8) as at, round(pi()*p_size,6) as pi, 1.0::double as lg, 0.0::double as nt, (case when p_size=10 then 1 else 0 end)::double as er from part")
rows("more_lookups", "orders", {"xm": "=IFNA(XMATCH([@o_custkey],customer[c_custkey]),0)", "lk": "=LOOKUP([@o_custkey],customer[c_custkey],customer[c_name])"}, ["o_orderkey"],
     "with c as (select *, row_number() over (order by c_custkey) r from customer) select o_orderkey, coalesce(r,0)::double as xm, c_name as lk from orders left join c on c_custkey=o_custkey", more=("customer",))

# -- criteria that depend on the row --------------------------------------------------------

rows("countifs_correlated", "customer", {"n": "=COUNTIFS(orders[o_custkey],[@c_custkey])"}, ["c_custkey"], "select c_custkey, coalesce(n,0)::double as n from customer left join (select o_custkey,count(*) n from orders group by 1) on o_custkey=c_custkey", more=("orders",))
rows("sumifs_correlated", "customer", {"s": '=ROUND(SUMIFS(orders[o_totalprice],orders[o_custkey],[@c_custkey],orders[o_orderstatus],"f"),2)', "a": "=ROUND(IFERROR(AVERAGEIFS(orders[o_totalprice],orders[o_custkey],[@c_custkey]),0),2)", "m": "=MAXIFS(orders[o_totalprice],orders[o_custkey],[@c_custkey])"}, ["c_custkey"],
     "select c_custkey, round(coalesce(sum(o_totalprice) filter (where o_orderstatus='F'),0),2) as s, round(coalesce(avg(o_totalprice),0),2) as a, coalesce(max(o_totalprice),0) as m from customer left join orders on o_custkey=c_custkey group by 1", more=("orders",))
rows("filter_per_row", "customer", {"s": '=IFERROR(ROUND(SUM(FILTER(orders[o_totalprice],(orders[o_custkey]=[@c_custkey])*(orders[o_orderstatus]="F"))),2),-1)', "n": "=IFERROR(ROWS(FILTER(orders[o_orderkey],orders[o_custkey]=[@c_custkey])),0)"}, ["c_custkey"],
     "select c_custkey, coalesce(round(sum(o_totalprice) filter (where o_orderstatus='F'),2),-1) as s, count(o_orderkey)::double as n from customer left join orders on o_custkey=c_custkey group by 1", more=("orders",))
rows("countif_below", "customer", {"n": '=COUNTIF(customer[c_acctbal],"<="&[@c_acctbal])', "g": '=COUNTIFS(customer[c_mktsegment],[@c_mktsegment],customer[c_acctbal],">"&[@c_acctbal])'}, ["c_custkey"],
     "select c_custkey, count(*) over (order by c_acctbal range unbounded preceding)::double as n, (rank() over (partition by c_mktsegment order by c_acctbal desc)-1)::double as g from customer")
rows("countifs_between", "customer", {"n": '=COUNTIFS(orders[o_totalprice],">="&[@c_acctbal]*10,orders[o_totalprice],"<"&[@c_acctbal]*10+5000)', "s": '=ROUND(SUMIFS(orders[o_totalprice],orders[o_totalprice],">"&[@c_acctbal]*10,orders[o_totalprice],"<="&[@c_acctbal]*10+5000),2)', "g": '=COUNTIFS(customer[c_mktsegment],[@c_mktsegment],customer[c_acctbal],">"&[@c_acctbal]-500,customer[c_acctbal],"<"&[@c_acctbal])'}, ["c_custkey"],
     "select c.c_custkey, (select count(*) from orders where o_totalprice>=c_acctbal*10 and o_totalprice<c_acctbal*10+5000)::double as n, (select round(coalesce(sum(o_totalprice),0),2) from orders where o_totalprice>c_acctbal*10 and o_totalprice<=c_acctbal*10+5000) as s, (select count(*) from customer d where d.c_mktsegment=c.c_mktsegment and d.c_acctbal>c.c_acctbal-500 and d.c_acctbal<c.c_acctbal)::double as g from customer c", more=("orders",))
rows("maxifs_bound", "customer", {"m": '=MAXIFS(orders[o_totalprice],orders[o_totalprice],"<="&[@c_acctbal]*20)', "l": '=MINIFS(orders[o_totalprice],orders[o_custkey],[@c_custkey],orders[o_totalprice],">"&[@c_acctbal]*10)'}, ["c_custkey"],
     "select c_custkey, (select coalesce(max(o_totalprice),0) from orders where o_totalprice<=c_acctbal*20) as m, (select coalesce(min(o_totalprice),0) from orders where o_custkey=c_custkey and o_totalprice>c_acctbal*10) as l from customer", more=("orders",))
rows("filter_reductions", "customer", {"md": "=IFERROR(MEDIAN(FILTER(orders[o_totalprice],orders[o_custkey]=[@c_custkey])),-1)", "l2": "=IFERROR(LARGE(FILTER(orders[o_totalprice],orders[o_custkey]=[@c_custkey]),2),-1)", "s1": '=IFERROR(SMALL(FILTER(orders[o_totalprice],(orders[o_custkey]=[@c_custkey])*(orders[o_orderstatus]="O")),1),-1)', "tj": '=IFERROR(TEXTJOIN("-",TRUE,FILTER(orders[o_orderstatus],orders[o_custkey]=[@c_custkey])),"none")', "sd": "=IFERROR(ROUND(STDEV.S(FILTER(orders[o_totalprice],orders[o_custkey]=[@c_custkey])),3),-1)"}, ["c_custkey"],
     "with o as (select *, row_number() over (partition by o_custkey order by o_totalprice desc) r from orders) select c_custkey, coalesce(median(o_totalprice),-1) as md, coalesce(max(o_totalprice) filter (where r=2),-1) as l2, coalesce(min(o_totalprice) filter (where o_orderstatus='O'),-1) as s1, coalesce(string_agg(o_orderstatus,'-' order by o_orderkey),'none') as tj, coalesce(round(stddev_samp(o_totalprice),3),-1) as sd from customer left join o on o_custkey=c_custkey group by 1", more=("orders",))
rows("share_of_total", "customer", {"share": "=[@c_acctbal]/SUM(customer[c_acctbal])", "gap": "=[@c_acctbal]-AVERAGE(customer[c_acctbal])"}, ["c_custkey"], "select c_custkey, c_acctbal/(select sum(c_acctbal) from customer) as share, c_acctbal-(select avg(c_acctbal) from customer) as gap from customer")

# -- windows --------------------------------------------------------------------------------

rows("rank_eq", "customer", {"r": "=RANK.EQ([@c_acctbal],customer[c_acctbal])", "up": "=RANK.EQ([@c_acctbal],customer[c_acctbal],1)", "av": "=RANK.AVG([@c_acctbal],customer[c_acctbal])"}, ["c_custkey"],
     "select c_custkey, rank() over (order by c_acctbal desc)::double as r, rank() over (order by c_acctbal)::double as up, rank() over (order by c_acctbal desc)+(count(*) over (partition by c_acctbal)-1)/2.0 as av from customer")
rows("percentrank", "customer", {"p": "=PERCENTRANK.INC(customer[c_acctbal],[@c_acctbal],6)"}, ["c_custkey"], "select c_custkey, floor(percent_rank() over (order by c_acctbal)*1000000+1e-12)/1000000 as p from customer")
rows("percentrank_legacy", "supplier", {"p": "=PERCENTRANK(supplier[s_acctbal],[@s_acctbal],6)"}, ["s_suppkey"], "select s_suppkey, floor(percent_rank() over (order by s_acctbal)*1000000+1e-9)/1000000 as p from supplier")
rows("running_sum", "events", {"rs": "=ROUND(SUM(E$1:E1),2)", "rc": "=COUNT(E$1:E1)", "rx": "=MAX(E$1:E1)"}, ["event_id"], "select event_id, floor(sum(value) over w*100+0.5)/100 as rs, (count(value) over w)::double as rc, max(value) over w as rx from events window w as (order by event_id rows unbounded preceding)", anchor=1)
rows("moving_frame", "events", {"ms": "=MAX(E1:E4)", "mn": "=MIN(E1:E2)"}, ["event_id"], "select event_id, max(value) over (order by event_id rows between current row and 3 following) as ms, min(value) over (order by event_id rows between current row and 1 following) as mn from events", anchor=1)

# -- array formulas -------------------------------------------------------------------------

spill("groupby_sum", '=GROUPBY(lineitem[l_returnflag],lineitem[net],"SUM",0,0,1)', ("lineitem",), "select l_returnflag, round(sum(l_extendedprice*(1-l_discount)),2) as net from lineitem group by 1", rounded={"net": 2})
spill("groupby_total", '=GROUPBY(lineitem[l_returnflag],lineitem[l_quantity],"SUM",0,1,1)', ("lineitem",), "select l_returnflag, sum(l_quantity) as l_quantity from lineitem group by 1 union all select 'Grand Total', sum(l_quantity) from lineitem")
spill("groupby_many", '=GROUPBY(orders[[o_orderstatus]:[o_orderstatus]],HSTACK(orders[o_totalprice],orders[o_orderkey]),"MAX",0,0,-1)', ("orders",), "select o_orderstatus, max(o_totalprice) as o_totalprice, max(o_orderkey)::double as o_orderkey from orders group by 1")
spill("groupby_average", "=GROUPBY(lineitem[[l_returnflag]:[l_linestatus]],lineitem[l_quantity],1)", ("lineitem",), "select l_returnflag, l_linestatus, round(avg(l_quantity),5) as l_quantity from lineitem group by 1,2", rounded={"l_quantity": 5})
spill("pivotby", '=PIVOTBY(orders[o_orderpriority],orders[o_orderstatus],orders[o_totalprice],"SUM")', ("orders",), 'select o_orderpriority, round(sum(o_totalprice) filter (where o_orderstatus=\'F\'),2) as "F", round(sum(o_totalprice) filter (where o_orderstatus=\'O\'),2) as "O", round(sum(o_totalprice) filter (where o_orderstatus=\'P\'),2) as "P" from orders group by 1', rounded={"F": 2, "O": 2, "P": 2})
spill("pivotby_totals", '=PIVOTBY(orders[o_orderpriority],orders[o_orderstatus],orders[o_orderkey],"COUNT",0,1,1,1,1)', ("orders",), 'select coalesce(o_orderpriority,\'Grand Total\') as o_orderpriority, count(*) filter (where o_orderstatus=\'F\')::double as "F", count(*) filter (where o_orderstatus=\'O\')::double as "O", count(*) filter (where o_orderstatus=\'P\')::double as "P", count(*)::double as "Grand Total" from orders group by rollup(o_orderpriority)')
spill("filter_rows", "=FILTER(orders[[o_orderkey]:[o_totalprice]],(orders[o_totalprice]>100000)*(orders[o_orderstatus]=\"O\"))", ("orders",), "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_totalprice>100000 and o_orderstatus='O'")
spill("filter_above_average", "=FILTER(part[[p_partkey]:[p_name]],part[p_retailprice]>AVERAGE(part[p_retailprice]))", ("part",), "select p_partkey, p_name from part where p_retailprice>(select avg(p_retailprice) from part)")
spill("filter_empty", '=FILTER(nation[n_name],nation[n_nationkey]>1000,"nothing")', ("nation",), "select 'nothing' as n_name")
spill("unique_rows", "=UNIQUE(orders[[o_orderstatus]:[o_orderstatus]])", ("orders",), "select distinct o_orderstatus from orders")
spill("unique_pairs", "=UNIQUE(CHOOSECOLS(orders,3,6))", ("orders",), "select distinct o_orderstatus, o_orderpriority from orders")
spill("unique_once", "=UNIQUE(orders[o_custkey],FALSE,TRUE)", ("orders",), "select o_custkey from orders group by 1 having count(*)=1")
spill("count_distinct", "=ROWS(UNIQUE(orders[o_custkey]))", ("orders",), "select count(distinct o_custkey)::double as value from orders")
spill("top_k", "=TAKE(SORT(CHOOSECOLS(orders,1,4),2,-1),10)", ("orders",), "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
spill("bottom_rows", "=TAKE(customer[[c_custkey]:[c_name]],-5)", ("customer",), "select c_custkey, c_name from customer order by c_custkey desc limit 5")
spill("drop_rows", "=DROP(customer[[c_custkey]:[c_name]],10)", ("customer",), "select c_custkey, c_name from customer order by c_custkey offset 10")
spill("choose_rows", "=CHOOSEROWS(customer[[c_custkey]:[c_name]],1,3,-1)", ("customer",), "select c_custkey, c_name from (select *, row_number() over (order by c_custkey) r, count(*) over () n from customer) where r in (1,3,n)")
spill("sort_rows", "=SORT(supplier[[s_suppkey]:[s_name]],2,-1)", ("supplier",), "select s_suppkey, s_name from supplier")
spill("sortby_take", "=TAKE(SORTBY(CHOOSECOLS(customer,1,5),customer[c_mktsegment],1,customer[c_acctbal],-1),20)", ("customer",), "select c_custkey, c_mktsegment from customer order by lower(c_mktsegment), c_acctbal desc, c_custkey limit 20")
spill("vstack", "=VSTACK(customer[c_name],supplier[s_name])", ("customer", "supplier"), "select c_name as name from customer union all select s_name from supplier", ["name"])
spill("hstack", "=HSTACK(customer[c_name],part[p_name])", ("customer", "part"), "select c_name, p_name from (select c_name, row_number() over (order by c_custkey) r from customer) a full join (select p_name, row_number() over (order by p_partkey) r from part) b using (r)")
spill("tocol", "=TOCOL(nation[[n_nationkey]:[n_name]])", ("nation",), "select n_nationkey::varchar as value from nation union all select n_name from nation")
spill("transpose", "=TRANSPOSE(region[[r_regionkey]:[r_regionkey]])", ("region",), "select * from (select 0 as c1, 1 as c2, 2 as c3, 3 as c4, 4 as c5)")
spill("torow", "=TOROW(region[[r_regionkey]:[r_regionkey]])", ("region",), "select * from (select 0 as c1, 1 as c2, 2 as c3, 3 as c4, 4 as c5)")
spill("sequence", "=SEQUENCE(100,1,5,3)", ("region",), "select (5+3*i)::double as value from range(100) t(i)")
spill("textsplit", '=TEXTSPLIT(part[p_name]," ")', ("part",), "select unnest(string_split(p_name,' ')) as value from part")
spill("frequency", "=FREQUENCY(lineitem[l_quantity],{10,20,30})", ("lineitem",), "select * from (select 10.0::double as upto, count(*) filter (where l_quantity<=10) as value from lineitem union all select 20.0, count(*) filter (where l_quantity>10 and l_quantity<=20) from lineitem union all select 30.0, count(*) filter (where l_quantity>20 and l_quantity<=30) from lineitem union all select null, count(*) filter (where l_quantity>30) from lineitem)")
spill("mode_mult", "=MODE.MULT(part[p_size])", ("part",), "select p_size::double as value from part group by 1 having count(*)=(select max(n) from (select count(*) n from part group by p_size))")
spill("linest", "=LINEST(lineitem[l_extendedprice],lineitem[l_quantity])", ("lineitem",), "select round(regr_slope(l_extendedprice,l_quantity),4) as slope, round(regr_intercept(l_extendedprice,l_quantity),4) as intercept from lineitem", rounded={"slope": 4, "intercept": 4})
spill("trend", "=TREND(lineitem[l_extendedprice],lineitem[l_quantity],{1;2;3})", ("lineitem",), "select round(regr_intercept(l_extendedprice,l_quantity)+x*regr_slope(l_extendedprice,l_quantity),4) as value from lineitem, (select unnest([1,2,3]) x) group by x", rounded={"value": 4})

# -- files, ports, cells and streams --------------------------------------------------------


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and read back with strict inference."""
    path = work_path(spark, "part-csv")
    write_csv(spark.read.parquet(f"{sf_dir}/part.parquet"), path)
    return read_csv(spark, path).withColumn("p_partkey", F.col("p_partkey").cast("long"))


QUERIES["csv_round_trip"] = csv_round_trip
SQL["csv_round_trip"] = "select p_partkey, p_name, p_brand, p_type, p_size::double as p_size, p_retailprice from part"

#: A small model: price, discount and quantity in, net and a grade out.
MODEL = """{"ports": [
 {"id": "price", "dir": "in", "shape": "scalar", "location": {"a1": "Model!A1"}, "schema": {"type": "number"}, "constraints": {"min": 0}},
 {"id": "discount", "dir": "in", "shape": "scalar", "location": {"name": "discount"}, "schema": {"type": "number"}},
 {"id": "net", "dir": "out", "shape": "scalar", "location": {"a1": "Model!A4"}, "schema": {"type": "number"}},
 {"id": "grade", "dir": "out", "shape": "scalar", "location": {"a1": "Model!A5"}, "schema": {"type": "string"}}]}"""


def port_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook as a function over a scenario a row; those that break a constraint carry an error."""
    model = Workbook()
    model.set_values("Model", 1, 1, [[0], [0]])
    model.define_name("discount", "=Model!A2")
    model.set_formulas("Model", 4, 1, [["=A1*(1-discount)"], ['=XLOOKUP(A4,{0,1000,50000},{"low","mid","high"},,-1)']])
    scenarios = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") - 2000).alias("price"), ((F.col("o_orderkey") % 10) / 100).alias("discount"))
    return SheetFunction(model, manifest(MODEL)).over(scenarios).select("o_orderkey", "net", "grade", F.col("error").isNotNull().alias("failed"))


QUERIES["port_scenarios"] = port_scenarios
SQL["port_scenarios"] = """
with s as (select o_orderkey, o_totalprice-2000 as price, (o_orderkey%10)/100.0::double as discount from orders)
select o_orderkey, case when price>=0 then price*(1-discount) end as net,
       case when price<0 then null when price*(1-discount)>=50000 then 'high' when price*(1-discount)>=1000 then 'mid' else 'low' end as grade, price<0 as failed from s
"""


def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet filled from a table, with formulas; its cells as a frame."""
    rows_ = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows
    sheet = Workbook()
    sheet.set_values("N", 1, 1, [[r.n_nationkey, r.n_regionkey] for r in rows_])
    sheet.set_formulas("N", 1, 3, [[f"=A{i}*10+B{i}"] for i in range(1, len(rows_) + 1)])
    sheet.set_formula("N", 1, 5, f"=SUM(C1:C{len(rows_)})")
    cells = sheet.to_frame(spark).where("formula is not null")
    return cells.select("row", "col", "num")


QUERIES["workbook_cells"] = workbook_cells
SQL["workbook_cells"] = 'select (n_nationkey+1)::int as "row", 3::int as col, (n_nationkey*10+n_regionkey)::double as num from nation union all select 1, 5, sum(n_nationkey*10+n_regionkey)::double from nation'


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reductions over event-time windows of a stream that is run to its end."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    got = windowed(stream, "ts", "30 days", {"n": "=COUNT(stream[value])", "views": '=COUNTIFS(stream[event_type],"view",stream[value],">=50")', "total": "=SUM(stream[value])"}, watermark="3650 days")
    path = work_path(spark, "windows")
    query = got.writeStream.outputMode("complete").option("checkpointLocation", path + "-state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.parquet(path).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n", "views", F.round("total", 2).alias("total"))


QUERIES["stream_windows"] = stream_windows
SQL["stream_windows"] = "select strftime(time_bucket(interval 30 days, ts, timestamp '1970-01-01'),'%Y-%m-%d') as start, count(value)::double as n, (count(*) filter (where event_type='view' and value>=50))::double as views, round(sum(value),2) as total from events group by 1"
