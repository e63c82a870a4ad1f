"""The language layer: statements, expressions, programs, macros."""

import pytest

from provena.lang.expr import SyntaxProblem, parse as expression, references
from provena.lang.lexer import statements
from provena.lang.macro import arithmetic, condition, expand
from provena.lang.parser import parse


def outputs(code, **options):
    return [(s.outputs[0].lib or s.outputs[0].name) for s in parse(code, **options).data_steps]


def test_statements_keep_quotes_comments_and_lines():
    got = statements("a = 'x;y'; /* c;\n */ b = 2;\n* gone; c\n= 3;")
    assert [(s.text, s.line) for s in got] == [("a = 'x;y'", 1), ("b = 2", 2), ("c = 3", 3)]


def test_inline_data_is_opaque():
    got = statements("data t; input x y $; datalines;\n1 a\n2 b = 3\n;\nrun;")
    assert [s.text for s in got] == ["data t", "input x y $", "datalines", "run"]
    assert got[2].data == ("1 a", "2 b = 3")


def test_step_with_inputs_and_assignments():
    step = parse("data out; set a b; total = qty * price; run;").data_steps[0]
    assert [t.name for t in step.inputs] == ["a", "b"]
    assert [(f.name, f.expression, f.deps) for f in step.fields] == [("total", "qty * price", [("qty", "a"), ("price", "a")])]


def test_merge_options_and_keys():
    step = parse("data m; merge a (in=x keep=k v) b (in=y); by k descending d; if x and y; run;").data_steps[0]
    assert [t.name for t in step.inputs] == ["a", "b"] and step.inputs[0].options["in"] == "x"
    assert step.keys == ["k", "d"]


def test_steps_close_without_run_and_names_like_run_do_not_close():
    p = parse("data a; set x; running_total = v + 1; data b; set a; proc sort data=b out=c; by k; run;")
    assert [s.output for s in p.data_steps] == ["a", "b"]
    assert [f.name for f in p.data_steps[0].fields] == ["running_total"]
    assert (p.proc_steps[0].proc, p.proc_steps[0].inputs[0].name, p.proc_steps[0].outputs[0].name) == ("SORT", "b", "c")


def test_conditions_are_control_dependencies():
    f = parse("data a; set x; if p < 1 then q = r; else q = 2; run;").data_steps[0].fields
    assert [(i.name, i.deps, i.controls) for i in f] == [("q", [("r", "x")], [("p", "x")]), ("q", [], [("p", "x")])]


def test_literals_and_functions_are_no_references():
    assert references(expression("TRIM(a) || ' b c' || PUT(d, 4.) + 0.08 + t.e")) == [("a", None), ("d", None), ("e", "t")]


@pytest.mark.parametrize("text,tree", [
    ("1 + 2 * 3", ("bin", "+", ("num", 1.0), ("bin", "*", ("num", 2.0), ("num", 3.0)))),
    ("-x ** 2", ("un", "-", ("bin", "**", ("name", "x"), ("num", 2.0)))),
    ("a = 1 and not b", ("bin", "and", ("bin", "=", ("name", "a"), ("num", 1.0)), ("un", "not", ("name", "b")))),
    ("x in (1, 2)", ("in", ("name", "x"), (("num", 1.0), ("num", 2.0)))),
    ("first.k", ("flag", "first", "k")), (".", ("missing",)),
])
def test_precedence(text, tree):
    assert expression(text) == tree


def test_bad_expressions_are_problems():
    for bad in ("1 +", "(a", "a b", "f(1"):
        with pytest.raises(SyntaxProblem):
            expression(bad)


def test_symbols_and_libraries():
    p = parse("%let lib = stg;\ndata &lib..raw; set &lib..src; y = 100; run;", expand_macros=True)
    assert outputs("%let lib = stg;\ndata &lib..raw; set &lib..src; y = 100; run;", expand_macros=True) == ["stg"]
    assert p.data_steps[0].inputs[0].lib == "stg"


def test_counting_loop():
    code = "%macro m(p, n); %do i = 1 %to &n; data &p._&i; set s_&i; a = b_&i * 2; run; %end; %mend; %m(out, 3);"
    assert outputs(code, expand_macros=True) == ["out_1", "out_2", "out_3"]


def test_branches_and_nesting():
    code = "%macro m(f); %if &f = Y %then %do; %do j = 1 %to 2; data y&j; x = 1; run; %end; %end; %else %do; data n; x = 2; run; %end; %mend; %m(Y) %m(N)"
    assert outputs(code, expand_macros=True) == ["y1", "y2", "n"]


def test_functions_drive_loops():
    code = "%let l = a b c; %macro g; %do i = 1 %to %sysfunc(countw(&l)); %let w = %scan(&l, &i); data d_&w; set s_&w; x = &i; run; %end; %mend; %g"
    p = parse(code, expand_macros=True)
    assert [(s.output, s.inputs[0].name) for s in p.data_steps] == [("d_a", "s_a"), ("d_b", "s_b"), ("d_c", "s_c")]
    assert outputs("%let l = x y; %macro g; %do %over(&l); data d_&i; x = 1; run; %end; %mend; %g", expand_macros=True) == ["d_x", "d_y"]


def test_arithmetic_and_conditions():
    assert outputs("%let k = %eval(5 + 7); data t&k; z = &k; run;", expand_macros=True) == ["t12"]
    assert arithmetic("2 ** 3 + 10 / 4") == 10.5
    assert condition("a = A and 1 < 2") and not condition("not (3 ge 2)") and condition("x = 1 or y = y")
    assert expand("%eval(7/2)") == "3" and expand("%sysevalf(7/2)") == "3.5"


def test_text_functions():
    assert expand("%upcase(ab)-%substr(hello, 2, 3)-%scan(a b c, 2)-%index(abc, c)-%length(four)") == "AB-ell-b-3-4"
    assert expand("%cmpres(a   b)-%tranwrd(a-b, b, c)-%reverse(abc)-%sysfunc(int(3.7))-%max(2, 9)") == "a b-a-c-cba-3-9"


def test_while_until_and_scopes():
    assert expand("%macro w; %let i = 0; %do %while(&i < 3); %let i = %eval(&i + 1); r&i %end; %mend; %w").split() == ["r1", "r2", "r3"]
    assert expand("%let x = 1; %macro m(x); &x %mend; %m(2) &x").split() == ["2", "1"]
    assert expand("%let a1 = z; %let i = 1; &&a&i") .split() == ["z"]


def test_broken_macros_leave_the_source():
    code = "%macro b; %do %while (0); %mend; data real; set raw; v = 1; run;"
    assert outputs(code) == ["real"] and outputs(code, expand_macros=True) == ["real"]
    endless = "%macro m; %do %while(1); x %end; %mend; %m data a; run;"
    assert expand(endless) == endless


def test_include_stays_in_its_folder(tmp_path):
    (tmp_path / "part.sas").write_text("data b; set a; x = 2; run;\n")
    code = 'data top; set src; y = 1; run;\n%include "part.sas";\n'
    assert outputs(code, include_base=tmp_path) == ["top", "b"]
    assert outputs(code, expand_macros=True) == ["top"]
    assert outputs('%include "../part.sas";', include_base=tmp_path) == []


def test_a_call_inside_a_statement_leaves_its_semicolon():
    code = "%macro dbl(x); &x*2 %mend; data t; x=%dbl(3); y=2; z=%unknown(3); w=4; run;"
    assert [(f.name, f.expression.replace(" ", "")) for f in parse(expand(code)).data_steps[0].fields if f.name in "xyw"] == [("x", "3*2"), ("y", "2"), ("w", "4")]
    assert "; ;" not in expand("%macro m; data t; x = 1; run; %mend; %m; data u; y = 2; run;")
