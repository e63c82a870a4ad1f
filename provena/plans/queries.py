"""Registered queries of the lineage and DATA-step engine, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions.compile import Env, compile_expr
from provena.lang import expr as E
from provena.operators import graph, lineage
from provena.operators.catalog import Catalog
from provena.operators.ordered import lagged, running_sum
from provena.operators.trace import value_trace
from provena.plans import demo
from provena.plans.datastep import evaluate, match_merge, proc_means, run_program
from provena.sources.programs import programs, read_csv

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- DATA steps on the order tables ---------------------------------------------


def _run(spark, sf_dir, code: str, out: str, *names: str, order_by=None) -> DataFrame:
    return run_program(code, {n: table(spark, sf_dir, n) for n in names}, order_by=order_by, strict=True, spark=spark)[out]


@query("SELECT *, l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def assign_sequential(spark, sf_dir):
    """Later assignments see earlier ones of the same step."""
    return _run(spark, sf_dir, demo.REVENUE, "revenue_by_line", "lineitem")


@query("SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def assign_output_subset(spark, sf_dir):
    """Only what the wanted fields need is computed."""
    return evaluate(demo.REVENUE, "revenue_by_line", table(spark, sf_dir, "lineitem"), ["charge"])


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2.0 + l_tax AS a, l_extendedprice / l_quantity AS b FROM lineitem")
def assign_projection(spark, sf_dir):
    return _run(spark, sf_dir, "data t; set lineitem; a = l_quantity * 2 + l_tax; b = l_extendedprice / l_quantity; keep l_orderkey l_linenumber a b; run;", "t", "lineitem")


@query("SELECT p_partkey, CAST(p_size % 7 AS DOUBLE) AS m, CAST(-p_size AS DOUBLE) AS neg, CAST(pow(p_size, 2) AS DOUBLE) AS sq, CASE WHEN p_size - 10 = 0 THEN NULL ELSE p_retailprice / (p_size - 10) END AS ratio FROM part")
def scalar_arith_mod_pow(spark, sf_dir):
    return _run(spark, sf_dir, "data t; set part; m = p_size % 7; neg = -p_size; sq = p_size ** 2; ratio = p_retailprice / (p_size - 10); keep p_partkey m neg sq ratio; run;", "t", "part")


@query("SELECT o_orderkey, CASE WHEN o_totalprice - 100000 = 0 THEN NULL ELSE o_totalprice / (o_totalprice - 100000) END AS r, CAST(NULL AS DOUBLE) AS z FROM orders")
def safe_division(spark, sf_dir):
    return _run(spark, sf_dir, "data t; set orders; r = o_totalprice / (o_totalprice - 100000); z = o_totalprice / (o_orderkey - o_orderkey); keep o_orderkey r z; run;", "t", "orders")


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_tax + l_discount AS s, (l_quantity + l_tax) / 2 AS m FROM lineitem")
def scalar_sum_mean(spark, sf_dir):
    """Statistics over arguments leave missing ones out."""
    return _run(spark, sf_dir, "data t; set lineitem; s = SUM(l_quantity, l_tax, l_discount, .); m = MEAN(l_quantity, ., l_tax); keep l_orderkey l_linenumber s m; run;", "t", "lineitem")


@query("SELECT l_orderkey, l_linenumber, greatest(l_quantity, 25.0) AS hi, least(l_quantity, 25.0, l_tax) AS lo, l_tax AS one FROM lineitem")
def scalar_max_min(spark, sf_dir):
    return _run(spark, sf_dir, "data t; set lineitem; hi = MAX(l_quantity, 25); lo = MIN(l_quantity, 25, l_tax, .); one = MAX(l_tax); keep l_orderkey l_linenumber hi lo one; run;", "t", "lineitem")


@query("SELECT c_custkey, abs(c_acctbal) AS a, CAST(trunc(c_acctbal) AS DOUBLE) AS i, sign(c_acctbal) * floor(abs(c_acctbal) + 0.5) AS r, CAST(floor(c_acctbal) AS DOUBLE) AS f, CAST(ceil(c_acctbal) AS DOUBLE) AS c FROM customer")
def scalar_abs_round_int(spark, sf_dir):
    return _run(spark, sf_dir, "data t; set customer; a = ABS(c_acctbal); i = INT(c_acctbal); r = ROUND(c_acctbal); f = FLOOR(c_acctbal); c = CEIL(c_acctbal); keep c_custkey a i r f c; run;", "t", "customer")


@query("SELECT o_orderkey, CAST(o_totalprice > 150000 AS DOUBLE) AS big, CAST(o_orderstatus IN ('F', 'O') AS DOUBLE) AS known FROM orders")
def comparison_as_value(spark, sf_dir):
    return _run(spark, sf_dir, "data t; set orders; big = (o_totalprice > 150000); known = (o_orderstatus IN ('F', 'O')); keep o_orderkey big known; run;", "t", "orders")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice ELSE 0.0 END AS v FROM orders")
def conditional_expr(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    value = compile_expr(E.parse("o_totalprice if o_totalprice > 100000 else 0"), Env.of(df.schema), strict=True)
    return df.select("o_orderkey", value[0].alias("v"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band, CAST(CASE WHEN c_acctbal < 0 THEN 1 WHEN c_acctbal < 5000 THEN 2 ELSE 3 END AS DOUBLE) AS grade FROM customer")
def if_else_chain(spark, sf_dir):
    code = """data t; set customer; if c_acctbal < 0 then do; band = 'debt'; grade = 1; end;
    else if c_acctbal < 5000 then do; band = 'mid'; grade = 2; end; else do; band = 'high'; grade = 3; end; keep c_custkey band grade; run;"""
    return _run(spark, sf_dir, code, "t", "customer")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size > 20 AND p_retailprice > 300 AND NOT (p_brand = 'Brand#11')")
def subsetting_if(spark, sf_dir):
    return _run(spark, sf_dir, "data t; set part; where p_size > 20; if p_retailprice > 300; if p_brand = 'Brand#11' then delete; keep p_partkey p_retailprice; run;", "t", "part")


@query("SELECT p_partkey AS part, p_name AS name FROM part WHERE p_size <= 10")
def keep_drop_rename(spark, sf_dir):
    return _run(spark, sf_dir, "data t (rename=(p_name=name)); set part (where=(p_size <= 10) keep=p_partkey p_name p_size); rename p_partkey = part; drop p_size; run;", "t", "part")


@query("""SELECT p_partkey, upper(p_brand) AS u, substr(p_type, 1, 4) AS s, string_split(p_type, ' ')[1] AS w, CAST(strpos(p_name, 'a') AS DOUBLE) AS i,
CAST(length(p_name) AS DOUBLE) AS l, p_brand || '/' || CAST(p_size AS VARCHAR) AS c, replace(p_name, ' ', '') AS k, lpad(CAST(p_size AS VARCHAR), 4, '0') AS z FROM part""")
def sas_string_functions(spark, sf_dir):
    code = """data t; set part; u = UPCASE(p_brand); s = SUBSTR(p_type, 1, 4); w = SCAN(p_type, 1, ' '); i = INDEX(p_name, 'a'); l = LENGTH(p_name);
    c = TRIM(p_brand) || '/' || STRIP(p_size); k = COMPRESS(p_name); z = PUT(p_size, Z4.); keep p_partkey u s w i l c k z; run;"""
    return _run(spark, sf_dir, code, "t", "part")


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS y, CAST(month(o_orderdate) AS DOUBLE) AS m, CAST(quarter(o_orderdate) AS DOUBLE) AS q,
CAST(dayofweek(o_orderdate) + 1 AS DOUBLE) AS wd, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS days,
CAST(date_diff('month', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS months, CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS month_end FROM orders""")
def sas_date_functions(spark, sf_dir):
    code = """data t; set orders; d = DATEPART(o_orderdate); y = YEAR(d); m = MONTH(d); q = QTR(d); wd = WEEKDAY(d);
    days = INTCK('DAY', '01jan1995'd, d); months = INTCK('MONTH', '01jan1995'd, d); month_end = PUT(INTNX('MONTH', d, 0, 'E'), YYMMDD10.);
    keep o_orderkey y m q wd days months month_end; run;"""
    return _run(spark, sf_dir, code, "t", "orders")


@query("SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def set_concat(spark, sf_dir):
    code = """data t; set customer (keep=c_custkey c_name c_acctbal rename=(c_custkey=k c_name=name c_acctbal=bal)) supplier (keep=s_suppkey s_name s_acctbal rename=(s_suppkey=k s_name=name s_acctbal=bal)); run;"""
    return _run(spark, sf_dir, code, "t", "customer", "supplier")


_ORD = "SELECT o_custkey AS k, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1"


def _order_totals(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


def _user_totals(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n"))


def _merged(spark, sf_dir, totals: DataFrame, rest: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    code = f"data t; merge c (in=a) o (in=b); by k; {rest} keep k c_name n; run;"
    return run_program(code, {"c": c, "o": totals.select("k", "n")}, strict=True)["t"]


@query(f"SELECT coalesce(c.c_custkey, o.k) AS k, c_name, n FROM customer c FULL JOIN ({_ORD}) o ON c.c_custkey = o.k")
def merge_full(spark, sf_dir):
    return _merged(spark, sf_dir, _order_totals(spark, sf_dir), "")


@query("""SELECT coalesce(c.c_custkey, o.k) AS k, c_name, n FROM customer c FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) o ON c.c_custkey = o.k
WHERE c.c_custkey IS NULL OR o.k IS NULL""")
def merge_in_flags(spark, sf_dir):
    """Customers without events and users that are no customers."""
    return _merged(spark, sf_dir, _user_totals(spark, sf_dir), "if not (a and b);")


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders),
b AS (SELECT user_id AS k, event_id AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
n AS (SELECT coalesce(s.k, t.k) AS k, s.m AS na, t.m AS nb FROM (SELECT k, max(p) AS m FROM a GROUP BY k) s FULL JOIN (SELECT k, max(p) AS m FROM b GROUP BY k) t ON s.k = t.k),
g AS (SELECT k, na, nb, unnest(range(1, greatest(coalesce(na, 0), coalesce(nb, 0)) + 1)) AS p FROM n)
SELECT g.k, a.x, b.y FROM g LEFT JOIN a ON a.k = g.k AND a.p = least(g.p, na) LEFT JOIN b ON b.k = g.k AND b.p = least(g.p, nb)""")
def merge_many_to_many(spark, sf_dir):
    """All orders of a customer beside all events of the user of that number."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("x"))
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("y"))
    return match_merge(a, b, ["k"], ["x", "y"]).select("k", "x", "y")


@query("SELECT l_orderkey, sum(l_quantity) AS qty, CAST(count(*) AS DOUBLE) AS n, sum(l_quantity) / count(*) AS mean FROM lineitem GROUP BY 1")
def by_group_totals(spark, sf_dir):
    code = """data t; set lineitem; by l_orderkey; retain qty 0 n 0; if first.l_orderkey then do; qty = 0; n = 0; end;
    qty + l_quantity; n + 1; if last.l_orderkey then do; mean = qty / n; output; end; keep l_orderkey qty n mean; run;"""
    return _run(spark, sf_dir, code, "t", "lineitem", order_by=["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


@query("SELECT o_orderkey, sum(floor(o_totalprice)) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders")
def running_total_retain(spark, sf_dir):
    """A sum statement over the whole table, without one task that sees all rows."""
    df = table(spark, sf_dir, "orders")
    return running_sum(df, F.floor("o_totalprice"), ["o_orderkey"], "running").select("o_orderkey", "running")


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS DOUBLE) AS is_first,
CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS DOUBLE) AS is_last FROM orders""")
def first_last_rows(spark, sf_dir):
    code = "data t; set orders; by o_custkey; is_first = first.o_custkey; is_last = last.o_custkey; keep o_custkey o_orderkey is_first is_last; run;"
    return _run(spark, sf_dir, code, "t", "orders", order_by=["o_orderkey"])


@query("SELECT event_id, lag(value, 4) OVER (ORDER BY event_id) AS before FROM events")
def lag4(spark, sf_dir):
    return lagged(table(spark, sf_dir, "events").select("event_id", "value"), "value", 4, ["event_id"], "before").select("event_id", "before")


@query("SELECT l_returnflag, l_linestatus, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2")
def proc_sort_nodupkey(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return run_program("proc sort data=li out=s nodupkey; by l_returnflag l_linestatus; run;", {"li": df})["s"]


@query("""SELECT l_returnflag, 'l_quantity' AS variable, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS min, max(l_quantity) AS max, round(sum(l_quantity), 3) AS sum FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_tax', count(l_tax), round(avg(l_tax), 6), min(l_tax), max(l_tax), round(sum(l_tax), 3) FROM lineitem GROUP BY 1""")
def proc_means_by_class(spark, sf_dir):
    out = proc_means(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], ["l_returnflag"])
    return out.select("l_returnflag", "variable", "n", F.round("mean", 6).alias("mean"), "min", "max", F.round("sum", 3).alias("sum"))


@query("SELECT o_orderstatus, count(*) AS count, 100.0 * count(*) / sum(count(*)) OVER () AS percent FROM orders GROUP BY 1")
def proc_freq_status(spark, sf_dir):
    return run_program("proc freq data=orders out=f; tables o_orderstatus; run;", {"orders": table(spark, sf_dir, "orders")})["f"]


@query("SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) > 0 AS positive FROM customer GROUP BY 1")
def proc_sql_group(spark, sf_dir):
    code = "proc sql; create table t as select c_mktsegment, count(*) as n, sum(c_acctbal) > 0 as positive from customer group by c_mktsegment; quit;"
    return run_program(code, {"customer": table(spark, sf_dir, "customer")})["t"]


@query("SELECT r_regionkey, r_name, CAST(r_regionkey * 10 AS DOUBLE) AS code FROM region")
def csv_roundtrip_eval(spark, sf_dir):
    path = f"{graph.shared_folder(spark)}/region_csv_{abs(hash(sf_dir))}"
    table(spark, sf_dir, "region").write.mode("overwrite").option("header", True).csv(path)
    return evaluate("data t; set region; code = r_regionkey * 10; run;", "t", read_csv(spark, path, "r_regionkey int, r_name string"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, l_tax FROM lineitem), c AS (SELECT *, revenue * (1 + l_tax) AS charge FROM v)
SELECT l_orderkey, l_linenumber, 1 AS hop, 'staged' AS node, 'revenue' AS field, revenue AS value FROM c UNION ALL
SELECT l_orderkey, l_linenumber, 2, 'staged', 'charge', charge FROM c UNION ALL
SELECT l_orderkey, l_linenumber, 3, 'shipped', 'late_fee', charge * 0.02 FROM c UNION ALL
SELECT l_orderkey, l_linenumber, 4, 'report', 'total_due', charge + charge * 0.02 FROM c""")
def value_trace_lines(spark, sf_dir):
    """The value at every hop of a field, for every order line."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return value_trace(_catalog(spark), "pipeline", "report.total_due", rows, ["l_orderkey", "l_linenumber"]).drop("expr", "value_text")


@query("SELECT p_partkey, p_retailprice * 2 AS x, CAST(2 AS DOUBLE) AS y, p_size + 1.0 AS z FROM part")
def macro_inline_call(spark, sf_dir):
    """Calls inside statements: the semicolon behind them ends the statement."""
    code = """%macro twice(x); &x * 2 %mend; %macro step(name); data &name; set part; x = %twice(p_retailprice); y = 2; z = %unknown(3) p_size + 1; keep p_partkey x y z; run; %mend;
    %step(t);"""
    return run_program(code, {"part": table(spark, sf_dir, "part")}, strict=True, expand_macros=True)["t"]


@query("""SELECT r_regionkey, upper('aBc') AS upcase, lower('aBc') AS lowcase, CAST(length('abcde') AS DOUBLE) AS len, substr('abcdef', 2, 3) AS sub, split_part('one two three', ' ', 2) AS scan,
CAST(strpos('abcabc', 'ca') AS DOUBLE) AS ind, CAST(7 // 2 AS DOUBLE) AS ev, CAST(7 / 2 AS DOUBLE) AS sysev, trim('  ab  ') || '|' AS trimmed, regexp_replace('a   b    c', ' +', ' ', 'g') AS cmpres,
concat('a', 'b', 'c') AS cats, concat_ws('-', 'a', 'b', 'c') AS catx, CAST(greatest(3, 9, 4) AS DOUBLE) AS most, CAST(least(3, 9, 4) AS DOUBLE) AS least_of, repeat('ab', 3) AS rep,
translate('abc', 'a', 'x') AS trans, replace('one two one', 'one', '1') AS tranwrd, reverse('abc') AS rev, CAST(length(regexp_extract('aab1', '^[ab]*')) + 1 AS DOUBLE) AS ver,
sqrt(16.0) AS root, ceil(1.2) AS up, floor(1.8) AS down, CAST(strpos('hello', 'l') AS DOUBLE) AS indc, replace('a b c', ' ', '') AS compress, ltrim('  ab') AS lefted,
CAST(len(string_split('a b c', ' ')) AS DOUBLE) AS words, 'a,b' AS quoted, CAST(3 + 4 AS DOUBLE) AS symget FROM region""")
def macro_functions(spark, sf_dir):
    """The macro functions, each beside the SQL function that does the same."""
    code = """%let n = 3; data t; set region; upcase = "%upcase(aBc)"; lowcase = "%lowcase(aBc)"; len = %length(abcde); sub = "%substr(abcdef, 2, 3)"; scan = "%scan(one two three, 2)";
    ind = %index(abcabc, ca); ev = %eval(7 / 2); sysev = %sysevalf(7 / 2); trimmed = "%trim(  ab  )|"; cmpres = "%cmpres(a   b    c)"; cats = "%cats(a, b, c)"; catx = "%catx(-, a, b, c)";
    most = %max(3, 9, 4); least_of = %min(3, 9, 4); rep = "%repeat(ab, 2)"; trans = "%translate(abc, x, a)"; tranwrd = "%tranwrd(one two one, one, 1)"; rev = "%reverse(abc)"; ver = %verify(aab1, ab);
    root = %sqrt(16); up = %ceil(1.2); down = %floor(1.8); indc = %indexc(hello, xyzl); compress = "%compress(a b c)"; lefted = "%left(  ab)"; words = %sysfunc(countw(a b c)); quoted = "%str(a,b)";
    symget = %symget(n) + 4; drop r_name; run;"""
    return run_program(code, {"region": table(spark, sf_dir, "region")}, strict=True, expand_macros=True)["t"]


@query("""WITH a AS (SELECT nullif(n_regionkey, 2) AS k, n_nationkey AS x, row_number() OVER (PARTITION BY nullif(n_regionkey, 2) ORDER BY n_nationkey) AS p FROM nation),
b AS (SELECT nullif(r_regionkey, 2) AS k, r_name AS name FROM region) SELECT a.k, a.x, b.name FROM a LEFT JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def merge_null_keys(spark, sf_dir):
    """A missing key merges with a missing key."""
    key = lambda c: F.nullif(F.col(c), F.lit(2)).alias("k")
    a = table(spark, sf_dir, "nation").select(key("n_regionkey"), F.col("n_nationkey").alias("x"))
    b = table(spark, sf_dir, "region").select(key("r_regionkey"), F.col("r_name").alias("name"))
    return run_program("data t; merge a (in=here) b; by k; if here; run;", {"a": a, "b": b}, order_by=["x"], strict=True)["t"]


@query("""WITH m AS (SELECT c_custkey AS k, c_acctbal AS v, c_name AS name FROM customer), t AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS v FROM orders GROUP BY 1)
SELECT coalesce(m.k, t.k) AS k, coalesce(t.v, m.v) AS v, name FROM m FULL JOIN t ON m.k = t.k""")
def update_missing_keeps(spark, sf_dir):
    """UPDATE: the last change that is not missing counts, others leave the master's value."""
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_name").alias("name"))
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("v"), "o_orderkey")
    return run_program("data u; update m t; by k; keep k v name; run;", {"m": m, "t": t}, order_by=["o_orderkey"], strict=True)["u"]


@query("""SELECT event_id, coalesce(last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), -1) AS peak FROM events""")
def retain_carry(spark, sf_dir):
    """RETAIN carries a value that only some rows assign, over the whole table, without one task that sees all rows."""
    return _run(spark, sf_dir, "data t; set events; retain peak -1; if value > 50 then peak = value; keep event_id peak; run;", "t", "events", order_by=["event_id"])


@query("SELECT event_id, lag(value, 4) OVER (ORDER BY event_id) AS before, sum(coalesce(floor(value), 0)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM events")
def lag_and_sum_step(spark, sf_dir):
    """LAG4 and a sum statement in a DATA step."""
    return _run(spark, sf_dir, "data t; set events; before = LAG4(value); whole = FLOOR(value); total + whole; keep event_id before total; run;", "t", "events", order_by=["event_id"])


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 2.0 ELSE 0.0 END AS code, CASE WHEN o_totalprice < 1000 THEN 'low' WHEN o_totalprice < 100000 THEN 'mid' ELSE 'top' END AS band FROM orders")
def select_when(spark, sf_dir):
    code = """data t; set orders; select (o_orderstatus); when ('F') code = 1; when ('O') code = 2; otherwise code = 0; end;
    select; when (o_totalprice < 1000) band = 'low'; when (o_totalprice < 100000) band = 'mid'; otherwise band = 'top'; end; keep o_orderkey code band; run;"""
    return _run(spark, sf_dir, code, "t", "orders")


# --- lineage of the demonstration program ------------------------------------------


def _catalog(spark) -> Catalog:
    return Catalog.of(programs(spark, {"pipeline": demo.PIPELINE}))


_FIELDS = """fields(step_idx, stmt_idx, "table", name, expression) AS (VALUES (0, 0, 'staged', 'revenue', 'l_extendedprice * (1 - l_discount)'), (0, 1, 'staged', 'charge', 'revenue * (1 + l_tax)'),
(1, 0, 'margins', 'net', 'revenue - l_quantity * unit_cost'), (1, 1, 'margins', 'margin', 'net / revenue'), (2, 0, 'shipped', 'late_fee', 'charge * 0.02'),
(3, 0, 'report', 'total_due', 'charge + late_fee'), (3, 1, 'report', 'score', 'MAX(margin, 0)'), (3, 2, 'report', 'label', '''R'' || l_returnflag'))"""
_DEPS = """deps(step_idx, stmt_idx, dep) AS (VALUES (0, 0, 'l_extendedprice'), (0, 0, 'l_discount'), (0, 1, 'revenue'), (0, 1, 'l_tax'), (1, 0, 'revenue'), (1, 0, 'l_quantity'), (1, 0, 'unit_cost'),
(1, 1, 'net'), (1, 1, 'revenue'), (2, 0, 'charge'), (3, 0, 'charge'), (3, 0, 'late_fee'), (3, 1, 'margin'), (3, 2, 'l_returnflag')),
inputs(step_idx, pos, "table") AS (VALUES (0, 0, 'lineitem'), (1, 0, 'staged'), (2, 0, 'staged'), (3, 0, 'margins'), (3, 1, 'shipped'), (4, 0, 'report')),
outputs(step_idx, "table") AS (VALUES (0, 'staged'), (1, 'margins'), (2, 'shipped'), (3, 'report'), (4, 'final'))"""
_RESOLVED = """resolved AS (SELECT f."table" || '.' || f.name AS dst, f.name || ' = ' || f.expression AS formula, d.dep,
  coalesce((SELECT g."table" || '.' || g.name FROM fields g WHERE g.name = d.dep AND g.step_idx <= d.step_idx ORDER BY
    CASE WHEN g.step_idx < d.step_idx AND g."table" IN (SELECT i."table" FROM inputs i WHERE i.step_idx = d.step_idx) THEN 0 WHEN g.step_idx < d.step_idx THEN 1 ELSE 2 END, g.step_idx LIMIT 1),
    (SELECT i."table" FROM inputs i WHERE i.step_idx = d.step_idx AND i.pos = 0) || '.' || d.dep) AS src
  FROM deps d JOIN fields f USING (step_idx, stmt_idx)), edges AS (SELECT DISTINCT src, dst, formula FROM resolved WHERE src <> dst)"""
_BASE = f"WITH RECURSIVE {_FIELDS}, {_DEPS}, {_RESOLVED}"
_REACH = f"{_BASE}, reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)"
_DEPTH = f"{_BASE}, walk(node, depth) AS (SELECT src, 0 FROM edges UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON w.node = e.src), depths AS (SELECT node, max(depth) AS depth FROM walk GROUP BY 1)"
_LAYER = f"""{_BASE}, tedges AS (SELECT i."table" AS src, o."table" AS dst FROM inputs i JOIN outputs o USING (step_idx)), tables AS (SELECT src AS t FROM tedges UNION SELECT dst FROM tedges),
twalk(node, depth) AS (SELECT t, 0 FROM tables UNION SELECT e.dst, w.depth + 1 FROM twalk w JOIN tedges e ON w.node = e.src), layers AS (SELECT node, max(depth) AS col FROM twalk GROUP BY 1)"""


@query(f"{_BASE} SELECT \"table\" || '.' || name AS field_id, expression, CAST(step_idx AS INTEGER) AS step_idx FROM fields WHERE name = 'charge'")
def find_field(spark, sf_dir):
    return lineage.find_field(_catalog(spark), "charge").select("field_id", "expression", "step_idx")


@query(f"{_BASE} SELECT \"table\" || '.' || name AS field_id, name, expression FROM fields")
def all_fields(spark, sf_dir):
    return lineage.all_fields(_catalog(spark)).select("field_id", "name", "expression")


@query(f"{_BASE} SELECT \"table\" FROM inputs UNION SELECT \"table\" FROM outputs")
def program_tables(spark, sf_dir):
    return _catalog(spark).tables.select("table")


@query(f"{_BASE} SELECT \"table\", count(*) AS n_fields, string_agg(name, ',' ORDER BY name) AS fields FROM fields GROUP BY 1")
def browse_fields(spark, sf_dir):
    return lineage.browse_fields(_catalog(spark)).select("table", "n_fields", F.array_join("fields", ",").alias("fields"))


@query(f"{_BASE} SELECT count(*) AS total_fields, count(DISTINCT \"table\") AS total_tables, (SELECT count(*) FROM (SELECT DISTINCT step_idx, stmt_idx FROM deps)) AS fields_with_dependencies, CAST(1 AS BIGINT) AS max_depth FROM fields")
def browse_stats(spark, sf_dir):
    return lineage.browse_stats(_catalog(spark)).drop("program_id")


@query(f"{_BASE} SELECT dst AS field_id, dep AS dep_name, src AS source_id FROM resolved")
def resolve_dependencies(spark, sf_dir):
    return _catalog(spark).resolved.select("field_id", "dep_name", "source_id")


@query(f"{_BASE} SELECT src, dst, formula FROM edges")
def field_edges(spark, sf_dir):
    return _catalog(spark).edges.select("src", "dst", "formula")


@query(f"{_BASE} SELECT DISTINCT i.\"table\" || '.' || d.dep AS src, f.\"table\" || '.' || f.name AS dst FROM deps d JOIN fields f USING (step_idx, stmt_idx) JOIN inputs i ON i.step_idx = d.step_idx AND i.pos = 0")
def raw_edges(spark, sf_dir):
    return _catalog(spark).edges_raw.select("src", "dst")


@query(f"{_BASE} SELECT i.\"table\" AS src, o.\"table\" AS dst FROM inputs i JOIN outputs o USING (step_idx)")
def table_edges(spark, sf_dir):
    return _catalog(spark).table_edges.select("src", "dst")


@query(f"{_BASE} SELECT dst AS field_id, src AS source_id FROM edges")
def upstream_direct(spark, sf_dir):
    return lineage.upstream_direct(_catalog(spark)).select("field_id", "source_id")


@query(f"{_REACH} SELECT dst AS field_id, src AS source_id FROM reach")
def upstream_closure(spark, sf_dir):
    return lineage.upstream(_catalog(spark)).select("field_id", "source_id")


@query(f"{_REACH} SELECT src AS field_id, dst AS target_id FROM reach WHERE src = 'staged.revenue'")
def downstream_closure(spark, sf_dir):
    return lineage.downstream(_catalog(spark), "staged.revenue").select("field_id", "target_id")


@query(f"{_DEPTH} SELECT node AS field_id, CAST(depth AS INTEGER) AS depth FROM depths")
def lineage_depth(spark, sf_dir):
    return lineage.depth(_catalog(spark)).select("field_id", "depth")


@query(f"{_BASE}, p(dst, path, n) AS (SELECT 'lineitem.l_tax', 'lineitem.l_tax', 0 UNION SELECT e.dst, p.path || ' -> ' || e.dst, p.n + 1 FROM p JOIN edges e ON p.dst = e.src) SELECT path, CAST(n AS INTEGER) AS hops FROM p WHERE dst = 'report.total_due' ORDER BY n, path LIMIT 1")
def lineage_path(spark, sf_dir):
    return lineage.path(_catalog(spark), "lineitem.l_tax", "report.total_due").select(F.array_join("path", " -> ").alias("path"), "hops")


@query(f"{_BASE}, p(dst, path, n) AS (SELECT 'lineitem.l_tax', 'lineitem.l_tax', 0 UNION SELECT e.dst, p.path || ' -> ' || e.dst, p.n + 1 FROM p JOIN edges e ON p.dst = e.src) SELECT 'YES. report.total_due is affected by lineitem.l_tax via: ' || path || '.' AS answer FROM (SELECT path FROM p WHERE dst = 'report.total_due' ORDER BY n, path LIMIT 1) UNION ALL SELECT 'NO. report.score is not built from lineitem.l_tax.' WHERE NOT EXISTS (SELECT 1 FROM p WHERE dst = 'report.score')")
def affected_by(spark, sf_dir):
    cat = _catalog(spark)
    return lineage.affected(cat, "report.total_due", "lineitem.l_tax").union(lineage.affected(cat, "report.score", "lineitem.l_tax")).select("answer")


@query(f"{_BASE} SELECT DISTINCT src AS field_id FROM edges WHERE src NOT IN (SELECT \"table\" || '.' || name FROM fields)")
def golden_inputs(spark, sf_dir):
    return lineage.golden_inputs(_catalog(spark)).select("field_id")


@query(f"{_BASE} SELECT \"table\" || '.' || name AS field_id FROM fields WHERE \"table\" || '.' || name NOT IN (SELECT src FROM edges)")
def terminal_fields(spark, sf_dir):
    return lineage.terminal_fields(_catalog(spark)).select("field_id")


@query(f"{_LAYER} SELECT node AS \"table\", CAST(col AS INTEGER) AS col, CAST(row_number() OVER (PARTITION BY col ORDER BY node) - 1 AS INTEGER) AS \"row\" FROM layers")
def layer_columns(spark, sf_dir):
    return lineage.layers(_catalog(spark)).select("table", "col", "row")


@query(f"{_LAYER} SELECT t AS \"table\" FROM tables WHERE t NOT IN (SELECT dst FROM tedges)")
def golden_tables(spark, sf_dir):
    return lineage.golden_tables(_catalog(spark)).select("table")


@query(f"""{_LAYER} SELECT upper(node) AS name, CAST(col AS INTEGER) AS col, CASE col WHEN 0 THEN 'Golden sources' WHEN 1 THEN 'Landing' WHEN 2 THEN 'Curated' WHEN 3 THEN 'Marts' ELSE 'Reporting' END AS layer,
node NOT IN (SELECT dst FROM tedges) AS golden, (SELECT count(*) FROM fields f WHERE f."table" = node) AS field_count FROM layers""")
def explorer_nodes(spark, sf_dir):
    return lineage.nodes(_catalog(spark)).select("name", "col", "layer", "golden", "field_count")


@query(f"""{_REACH} SELECT f."table" || '.' || f.name AS field_id, CASE WHEN regexp_matches(f.expression, 'SUM|MEAN|MAX|MIN', 'i') OR regexp_matches(f.expression, '[-+*/]') THEN 'DECIMAL(18,2)' WHEN regexp_matches(f.expression, '''') THEN 'VARCHAR(140)' ELSE 'N/A' END AS dtype,
(SELECT string_agg(DISTINCT r.src, ',' ORDER BY r.src) FROM reach r WHERE r.dst = f."table" || '.' || f.name AND r.src NOT IN (SELECT "table" || '.' || name FROM fields)) AS inputs,
(SELECT count(DISTINCT r.src) FROM reach r WHERE r.dst = f."table" || '.' || f.name AND r.src IN (SELECT "table" || '.' || name FROM fields)) + 1 AS n_steps FROM fields f""")
def explorer_fields(spark, sf_dir):
    return lineage.field_traces(_catalog(spark)).select("field_id", "dtype", F.array_join("inputs", ",").alias("inputs"), F.size("steps").cast("long").alias("n_steps"))


@query(f"{_LAYER} SELECT (SELECT count(*) FROM fields) AS traced_fields, (SELECT count(*) FROM tables WHERE t NOT IN (SELECT dst FROM tedges)) AS golden_sources, (SELECT count(DISTINCT col) FROM layers) AS registers, (SELECT count(*) FROM tables) AS datasets")
def explorer_stats(spark, sf_dir):
    return lineage.stats(_catalog(spark)).drop("program_id")


@query("""SELECT 1 AS hop, 'staged.revenue' AS field, 'lineitem.l_discount,lineitem.l_extendedprice' AS inputs UNION ALL SELECT 2, 'staged.charge', 'lineitem.l_tax,staged.revenue'
UNION ALL SELECT 3, 'shipped.late_fee', 'staged.charge' UNION ALL SELECT 4, 'report.total_due', 'shipped.late_fee,staged.charge'""")
def construction_trace(spark, sf_dir):
    return lineage.hops(_catalog(spark), "report.total_due").select("hop", F.col("hop_field").alias("field"), F.array_join("inputs", ",").alias("inputs"))


@query("""SELECT 'Construction trace of shipped.late_fee:' || chr(10) || '1. staged.revenue = l_extendedprice * (1 - l_discount) (from lineitem.l_discount, lineitem.l_extendedprice)' || chr(10)
|| '2. staged.charge = revenue * (1 + l_tax) (from lineitem.l_tax, staged.revenue)' || chr(10) || '3. shipped.late_fee = charge * 0.02 (from staged.charge)' || chr(10)
|| 'Golden inputs: lineitem.l_discount, lineitem.l_extendedprice, lineitem.l_tax.' AS answer""")
def construction_text(spark, sf_dir):
    return lineage.construction(_catalog(spark), "shipped.late_fee").select("answer")


@query(f"""{_REACH} SELECT s.id AS field_id, (SELECT string_agg(DISTINCT r.dst, ',' ORDER BY r.dst) FROM reach r WHERE r.src = s.id) AS all_downstream,
(SELECT string_agg(DISTINCT r.dst, ',' ORDER BY r.dst) FROM reach r WHERE r.src = s.id AND r.dst NOT IN (SELECT src FROM edges)) AS terminal FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) s WHERE s.id IN (SELECT src FROM edges)""")
def downstream_impact(spark, sf_dir):
    rows = lineage.impact(_catalog(spark)).where(F.col("flows").isNotNull())
    return rows.select("field_id", F.array_join("all_downstream", ",").alias("all_downstream"), F.array_join("terminal_fields", ",").alias("terminal"))


@query(f"""{_BASE}, ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT 'digraph lineage {{' || chr(10) || '  node [shape=box];' || chr(10)
|| (SELECT string_agg('  "' || id || '" [label="' || id || '\\n' || CASE WHEN id IN (SELECT "table" || '.' || name FROM fields) THEN 'assignment' ELSE 'source' END || '"];', chr(10) ORDER BY '  "' || id || '" [label') FROM ids) || chr(10)
|| (SELECT string_agg('  "' || src || '" -> "' || dst || '";', chr(10) ORDER BY '  "' || src || '" -> "' || dst || '";') FROM edges) || chr(10) || '}}' AS dot""")
def dot_export(spark, sf_dir):
    return lineage.dot(_catalog(spark)).select("dot")


@query(f"{_DEPTH} SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n_fields FROM depths WHERE node IN (SELECT \"table\" || '.' || name FROM fields) GROUP BY 1")
def depth_histogram(spark, sf_dir):
    return lineage.depth_histogram(_catalog(spark)).select("depth", "n_fields")


@query(f"{_BASE} SELECT dst AS field_id, count(*) AS n_sources FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def dep_count_topk(spark, sf_dir):
    return lineage.most_dependencies(_catalog(spark), 3).select("field_id", "n_sources")


@query(f"{_BASE}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), comp(node, c) AS (SELECT src, src FROM both_ways UNION SELECT b.dst, comp.c FROM comp JOIN both_ways b ON comp.node = b.src) SELECT node, min(c) AS component FROM comp GROUP BY 1")
def graph_components(spark, sf_dir):
    return graph.components(_catalog(spark).edges).select("node", "component")


@query("SELECT 'a' AS node UNION ALL SELECT 'b' UNION ALL SELECT 'c'")
def graph_cycles(spark, sf_dir):
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "c", "d")], "program_id string, src string, dst string")
    return graph.on_cycles(edges).select("node")


@query("SELECT e AS expression, CASE WHEN regexp_matches(e, 'SUM|MEAN|MAX|MIN', 'i') OR regexp_matches(e, '[-+*/]') THEN 'DECIMAL(18,2)' WHEN regexp_matches(e, '[''\"]') THEN 'VARCHAR(140)' ELSE 'N/A' END AS dtype FROM (VALUES ('a + b'), ('sum(x)'), ('''x'''), ('plain')) t(e)")
def dtype_label(spark, sf_dir):
    df = spark.createDataFrame([(x,) for x in ("a + b", "sum(x)", "'x'", "plain")], "expression string")
    return df.select("expression", lineage.dtype_label(F.col("expression")).alias("dtype"))


@query("SELECT 1 AS id, true AS ok UNION ALL SELECT 2, false UNION ALL SELECT 3, false")
def citation_guard(spark, sf_dir):
    df = spark.createDataFrame([(1, ["A.x"], ["a.x", "b.y"]), (2, ["a.x", "z.z"], ["a.x"]), (3, [], ["a.x"])], "id int, cited array<string>, known array<string>")
    return df.select("id", lineage.cites_only(F.col("cited"), F.col("known")).alias("ok"))


@query("SELECT 'out_1' AS \"table\", 'src_1' AS source, 'base_1 * 2' AS expression UNION ALL SELECT 'out_2', 'src_2', 'base_2 * 2' UNION ALL SELECT 'out_3', 'src_3', 'base_3 * 2' UNION ALL SELECT 'no', 'b', '2'")
def macro_expansion(spark, sf_dir):
    cat = Catalog.of(programs(spark, {"macros": demo.MACROS}), expand_macros=True)
    return cat.fields.join(cat.step_inputs.select("program_id", "step_idx", F.col("table").alias("source")), ["program_id", "step_idx"]).select("table", "source", "expression")


@query("SELECT CAST(2 AS BIGINT) AS programs, CAST(0 AS BIGINT) AS failed, CAST(12 AS BIGINT) AS fields, CAST(8 AS BIGINT) AS data_steps")
def corpus_report(spark, sf_dir):
    cat = Catalog.of(programs(spark, {"pipeline": demo.PIPELINE, "macros": demo.MACROS}), expand_macros=True)
    return lineage.corpus_report(cat).select("programs", "failed", "fields", "data_steps")
