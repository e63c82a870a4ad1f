"""DATA steps and procedures on small tables, and expressions against a plain evaluator."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provena.functions.compile import Env, compile_expr
from provena.functions.registry import Unsupported, register
from provena.lang import expr as E
from provena.operators.ordered import lagged, numbered, running_sum
from provena.plans.datastep import StepError, evaluate, match_merge, run_program
from tests.conftest import rows


def test_evaluate_frame(spark):
    df = spark.createDataFrame([(10, 5), (20, 10), (15, 8)], "quantity int, price int")
    assert [r["total"] for r in evaluate("data t; set a; total = quantity * price; run;", "t", df).orderBy("total").collect()] == [50.0, 120.0, 200.0]
    assert evaluate("data t; set a; x = 1; run;", "other", df).columns == df.columns


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, 0.0)], "a double, b double")
    out = run_program("data t; set d; s = a + b; t = SUM(a, b); q = a / b; less = (a < b); same = (a = .); run;", {"d": df})["t"]
    got = rows(out.select("a", "s", "t", "q", "less", "same"))
    assert (1.0, None, 1.0, None, 0.0, 0.0) in got and (None, None, 2.0, None, 1.0, 1.0) in got and (3.0, 3.0, 3.0, None, 0.0, 0.0) in got


def test_guards_read_values_at_their_place(spark):
    df = spark.createDataFrame([(1.0,), (5.0,)], "x double")
    out = run_program("data t; set d; if x < 3 then do; x = x + 10; y = x; end; else y = 0; run;", {"d": df})["t"]
    assert rows(out) == [(11.0, 11.0), (5.0, 0.0)]


def test_explicit_output_to_several_tables(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    out = run_program("data lo hi (drop=y); set d; y = x * 2; if x < 3 then output lo; if x > 1 then output hi; run;", {"d": df})
    assert rows(out["lo"]) == [(1, 2.0), (2, 4.0)] and rows(out["hi"]) == [(2,), (3,)]


def test_match_merge_repeats_last_row(spark):
    a = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "k int, x string")
    b = spark.createDataFrame([(1, 10), (3, 30)], "k int, y int")
    assert rows(match_merge(a, b, ["k"]).select("k", "x", "y")) == [(1, "p", 10), (1, "q", 10), (2, "r", None), (3, None, 30)]


def test_match_merge_of_null_keys(spark):
    a = spark.createDataFrame([(None, "p"), (2, "r")], "k int, x string")
    b = spark.createDataFrame([(None, 10), (None, 11), (3, 30)], "k int, y int")
    got = match_merge(a, b, ["k"]).select("k", "x", "y", "__in_a", "__in_b")
    assert rows(got) == rows(spark.createDataFrame([(None, "p", 10, True, True), (None, "p", 11, True, True), (2, "r", None, True, False), (3, None, 30, False, True)], "k int, x string, y int, a boolean, b boolean"))


def test_update_keeps_what_a_change_lacks(spark):
    m = spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, "b"), (None, 5.0, "n")], "k int, v double, s string")
    c = spark.createDataFrame([(1, 1, None, "x"), (1, 2, 11.0, None), (3, 1, 30.0, None), (None, 1, 6.0, None)], "k int, o int, v double, s string")
    out = run_program("data t; update m c; by k; drop o; run;", {"m": m, "c": c}, order_by=["o"], strict=True)["t"]
    assert rows(out.select("k", "v", "s")) == rows(spark.createDataFrame([(1, 11.0, "x"), (2, 20.0, "b"), (3, 30.0, None), (None, 6.0, "n")], "k int, v double, s string"))


def test_retained_values_are_carried(spark):
    values = [None, 3.0, -1.0, None, 7.0, -2.0, 0.5] * 5
    df = spark.createDataFrame(list(enumerate(values)), "o int, v double").repartition(5)
    out = run_program("data t; set d; retain c 9 k 4; before = c; if v > 0 then c = v; after = c + k; run;", {"d": df}, order_by=["o"], strict=True)["t"]
    want, c = [], 9.0
    for o, v in enumerate(values):
        before = c
        c = v if v is not None and v > 0 else c
        want.append((o, before, c, c + 4))
    assert rows(out.select("o", "before", "c", "after")) == sorted(want, key=repr)
    with pytest.raises(StepError):  # each row needs the one before
        run_program("data t; set d; retain c 1; c = c * 2; run;", {"d": df}, order_by=["o"], strict=True)
    problems = []
    run_program("data t; set d; retain c 1; c = c * 2; run;", {"d": df}, order_by=["o"], problems=problems)
    assert problems


def test_select_is_a_chain_of_conditions(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (9.0,)], "x double")
    code = "data t; set d; select (x); when (1) y = 10; when (2, 3) do; y = 20; z = 1; end; otherwise y = 0; end; run;"
    assert rows(run_program(code, {"d": df}, strict=True)["t"].select("x", "y")) == [(1.0, 10.0), (2.0, 20.0), (3.0, 20.0), (9.0, 0.0)]
    code = "data t; set d; select; when (x < 2) y = 1; when (x < 4) y = 2; otherwise; end; run;"
    assert rows(run_program(code, {"d": df}, strict=True)["t"]) == rows(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 2.0), (9.0, None)], "x double, y double"))


@pytest.mark.parametrize("statement", ["stop", "call missing(x)", "array a{2} x y", "frobnicate x"])
def test_statements_without_a_plan_are_refused_or_reported(spark, statement):
    df, problems = spark.createDataFrame([(1.0,)], "x double"), []
    with pytest.raises(StepError):
        run_program(f"data t; set d; {statement}; y = x; run;", {"d": df}, strict=True)
    run_program(f"data t; set d; {statement}; y = x; run;", {"d": df}, problems=problems)
    assert problems


def test_lags_look_behind_short_ranges(spark):
    values = [None if k % 3 == 0 else float(k) for k in range(11)]
    df = spark.createDataFrame(list(enumerate(values)), "o int, v double")
    for n in (1, 4, 12):
        assert [r["l"] for r in lagged(df, "v", n, ["o"], "l").orderBy("o").collect()] == ([None] * n + values)[:11]


def test_retained_sums_and_flags(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 5.0)], "k string, o int, v double")
    code = "data t; set d; by k; retain s 0; if first.k then s = 0; s + v; if last.k; keep k s; run;"
    assert rows(run_program(code, {"d": df}, order_by=["o"])["t"]) == [("a", 5.0), ("b", 5.0)]
    with pytest.raises(StepError):
        run_program(code, {"d": df})


def test_order_without_one_task(spark):
    df = spark.range(50).select(F.col("id").alias("o"), (F.col("id") * 2).cast("double").alias("v")).repartition(5)
    assert [r["n"] for r in numbered(df, ["o"], "n").orderBy("o").collect()] == list(range(1, 51))
    assert [r["s"] for r in running_sum(df, F.col("v"), ["o"], "s").orderBy("o").collect()] == [float(k * (k + 1)) for k in range(50)]
    assert [r["l"] for r in lagged(df, "v", 3, ["o"], "l").orderBy("o").collect()] == [None] * 3 + [2.0 * k for k in range(47)]


def test_loops_lags_and_inline_data(spark):
    out = run_program("data t; input x y $; datalines;\n1 a\n. b\n; run;", {}, spark=spark)["t"]
    assert rows(out) == [(1.0, "a"), (None, "b")]
    out = run_program("data t; set d; s = 0; do i = 1 to 4; s = s + i * x; end; drop i; run;", {"d": spark.createDataFrame([(2.0,)], "x double")})["t"]
    assert rows(out) == [(2.0, 20.0)]
    df = spark.createDataFrame([(k, float(k)) for k in range(5)], "o int, x double")
    out = run_program("data t; set d; p = LAG2(x); keep o p; run;", {"d": df}, order_by=["o"])["t"]
    assert rows(out) == [(0, None), (1, None), (2, 0.0), (3, 1.0), (4, 2.0)]


def test_problems_are_reported_or_raised(spark):
    df, problems = spark.createDataFrame([(1.0,)], "x double"), []
    out = run_program("data t; set d; y = NOSUCH(x); run;", {"d": df}, problems=problems)["t"]
    assert rows(out) == [(1.0, None)] and problems
    with pytest.raises(Unsupported):
        run_program("data t; set d; y = NOSUCH(x); run;", {"d": df}, strict=True)
    register("nosuch", lambda x: (x[0] + 1, "num"))
    assert rows(run_program("data t; set d; y = NOSUCH(x); run;", {"d": df}, strict=True)["t"]) == [(1.0, 2.0)]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("Ann Lee ", "2020-02-29", 12.345)], "s string, d string, x double")

    def value(text):
        return df.select(compile_expr(E.parse(text), Env.of(df.schema), strict=True)[0]).first()[0]

    assert value("SCAN(s, 2, ' ')") == "Lee" and value("SCAN(s, -1)") == "Lee" and value("SCAN(s, 9)") == ""
    assert value("UPCASE(TRIM(s)) || '!'") == "ANN LEE!" and value("COMPRESS(s)") == "AnnLee" and value("CATX('-', 'a', '', 'b')") == "a-b"
    assert value("ROUND(2.5)") == 3 and value("ROUND(-2.5)") == -3 and value("ROUND(x, 0.01)") == pytest.approx(12.35) and value("INT(-1.7)") == -1
    assert value("MOD(-7, 3)") == -1 and value("-7 % 3") == 2 and value("PUT(7, Z3.)") == "007" and value("LENGTH('')") == 1
    assert value("YEAR(INPUT(d, YYMMDD10.))") == 2020 and str(value("INTNX('MONTH', INPUT(d, YYMMDD10.), 0, 'E')")) == "2020-02-29"
    assert value("INTCK('MONTH', '31jan2020'd, INPUT(d, YYMMDD10.))") == 1 and value("INPUT('1,234.5', COMMA10.)") == 1234.5 and value("INPUT('x', 8.)") is None


_leaf = st.sampled_from(["a", "b", "2", "0.5", "."])
_tree = st.recursive(_leaf, lambda x: st.tuples(x, st.sampled_from(["+", "-", "*", "/"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=6)


def plain(node, env):
    if node[0] == "num":
        return node[1]
    if node[0] == "name":
        return env[node[1]]
    if node[0] == "missing":
        return None
    a, b = plain(node[2], env), plain(node[3], env)
    if a is None or b is None or node[1] == "/" and b == 0:
        return None
    return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else None}[node[1]]


@settings(max_examples=12, deadline=None)
@given(st.lists(_tree, min_size=1, max_size=6))
def test_compiled_expressions_equal_a_plain_evaluator(spark, texts):
    env = {"a": 3.0, "b": -1.5}
    df = spark.createDataFrame([(3.0, -1.5)], "a double, b double")
    got = df.select(*[compile_expr(E.parse(t), Env.of(df.schema), strict=True)[0].alias(f"c{k}") for k, t in enumerate(texts)]).first()
    for t, g in zip(texts, got):
        want = plain(E.parse(t), env)
        assert (g is None) == (want is None) and (g is None or math.isclose(g, want, rel_tol=1e-12, abs_tol=1e-12)), t
