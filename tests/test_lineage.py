"""Catalogue and lineage questions on a three-step program, and graph properties on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from provena.operators import graph, lineage
from provena.operators.catalog import Catalog
from provena.operators.trace import value_trace
from provena.sources.programs import programs, read_programs
from tests.conftest import rows

CODE = """
data first; set src; gross = qty * price; cut = gross * rate; run;
data second; set first; net = gross - cut; profit = net - cost; share = profit / net; run;
data third; set second; total = SUM(profit); mean = MEAN(share); run;
"""


@pytest.fixture(scope="module")
def cat(spark):
    return Catalog.of(programs(spark, {"p": CODE, "bad": "data a; set b; x = (1; run;", "none": None}))


def mine(df):
    return df.where("program_id = 'p'").drop("program_id")


def test_programs_report_status(cat):
    got = {r["program_id"]: (r["status"], r["data_steps"]) for r in cat.programs.collect()}
    assert got == {"p": ("OK", 3), "bad": ("OK", 1), "none": ("OK", 0)}
    assert cat.fields.where("program_id = 'bad'").first()["problem"]


def test_resolution(cat):
    got = {(r["src"], r["dst"]) for r in mine(cat.edges).collect()}
    assert ("first.gross", "first.cut") in got and ("first.gross", "second.net") in got and ("first.cost", "second.profit") in got
    assert len(got) == 12


def test_browse_and_query(cat):
    assert mine(lineage.browse_stats(cat)).first().asDict() == {"total_fields": 7, "total_tables": 3, "fields_with_dependencies": 7, "max_depth": 1}
    r = lineage.query_field(cat, "profit").where("program_id = 'p'").first()
    assert r["found"] and r["depth"] == 4 and r["downstream"] == ["second.share", "third.mean", "third.total"]
    assert not lineage.query_field(cat, "nothing").where("program_id = 'p'").first()["found"]


def test_answers(cat):
    yes = lineage.affected(cat, "third.total", "src.qty").first()["answer"]
    assert yes == "YES. third.total is affected by src.qty via: src.qty -> first.gross -> second.net -> second.profit -> third.total."
    assert lineage.affected(cat, "first.gross", "third.total").first()["answer"] == "NO. first.gross is not built from third.total."
    assert lineage.affected(cat, "third.total", "unknown.x").count() == 0
    text = lineage.construction(cat, "second.profit").first()["answer"].split("\n")
    assert text[0] == "Construction trace of second.profit:" and text[-1] == "Golden inputs: first.cost, src.price, src.qty, src.rate."
    assert [t.split(" = ")[0] for t in text[1:-1]] == ["1. first.gross", "2. first.cut", "3. second.net", "4. second.profit"]
    assert lineage.impact(cat, "third.mean").where("program_id = 'p'").first()["answer"] == "No downstream use: third.mean is terminal."


def test_cited_ids_lie_in_the_universe(cat):
    u = lineage.universe(lineage.construction(cat, "second.profit")).first()["ids"]
    assert set(u) == {"second.profit", "second.net", "first.gross", "first.cut", "first.cost", "src.qty", "src.price", "src.rate"}


def test_layers_and_payload(cat):
    got = {r["id"]: (r["col"], r["layer"], r["golden"], r["field_count"]) for r in mine(lineage.nodes(cat)).collect()}
    assert got == {"src": (0, "Golden sources", True, 0), "first": (1, "Landing", False, 2), "second": (2, "Curated", False, 3), "third": (3, "Marts", False, 2)}
    assert "digraph lineage {" in mine(lineage.dot(cat)).first()["dot"]
    assert '"stats"' in lineage.payload(cat).where("program_id = 'p'").first()["payload"]


def test_value_trace(spark, cat):
    df = spark.createDataFrame([(1, 10.0, 50.0, 0.1, "200"), (2, 1.0, 1.0, 0.0, "")], "id int, qty double, price double, rate double, cost string")
    got = {(r["id"], r["field"]): r["value"] for r in value_trace(cat, "p", "third.total", df, ["id"]).collect()}
    assert got[1, "gross"] == 500 and got[1, "net"] == 450 and got[1, "profit"] == 250 and got[1, "total"] == 250
    assert got[2, "net"] == 1 and got[2, "profit"] is None and got[2, "total"] is None
    assert value_trace(cat, "p", "no.such", df, ["id"]).count() == 0


def test_files_are_read_once(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.sas").write_text("data a; x = 1; run;")
    (tmp_path / "sub" / "b.sas").write_text("data b; set a; y = x; run;")
    (tmp_path / "c.txt").write_text("no program")
    found = read_programs(spark, str(tmp_path)).orderBy("program_id").collect()
    assert [r["program_id"].rsplit("/", 1)[1] for r in found] == ["a.sas", "b.sas"] and all(r["program_id"] == r["path"] for r in found)


def test_programs_of_one_name_stay_apart(spark, tmp_path):
    for k, code in (("p", "data t; set s; x = p; run;"), ("q", "data t; set s; x = q; run;")):
        (tmp_path / k).mkdir()
        (tmp_path / k / "same.sas").write_text(code)
    got = Catalog.of(read_programs(spark, str(tmp_path))).edges.select("program_id", "src", "formula").collect()
    assert sorted((r["program_id"].split("/")[-2], r["src"], r["formula"]) for r in got) == [("p", "s.p", "x = p"), ("q", "s.q", "x = q")]


def test_programs_that_cannot_be_expanded_say_so(spark):
    code = "%macro m; %do i = 1 %to 2500; data t&i; x = &i; run; %end; %mend; %m;"
    got = Catalog.of(programs(spark, {"long": code, "fine": "%let a = 1; data t; x = &a; run;"}), expand_macros=True).programs.collect()
    assert {r["program_id"]: (r["status"], r["error"] is None) for r in got} == {"long": ("NOT_EXPANDED", False), "fine": ("OK", True)}


@pytest.mark.parametrize("grouped", [4000, 0])
def test_graphs_against_plain_python(spark, monkeypatch, grouped):
    monkeypatch.setattr(graph, "GROUPED", grouped)  # 0: all programs level by level
    rng = random.Random(4)
    edges = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(22)}
    df = spark.createDataFrame([("g", a, b) for a, b in edges], "program_id string, src string, dst string")
    reach = {}
    for s in {a for a, _ in edges}:
        level, seen, d = {b for a, b in edges if a == s}, {}, 1
        while level:
            seen |= {x: d for x in level}
            level = {b for a, b in edges if a in level} - set(seen)
            d += 1
        reach |= {(s, t): k for t, k in seen.items()}
    assert {(r["src"], r["dst"]): r["distance"] for r in graph.reach(df).collect()} == reach
    paths = graph.shortest_paths(df, df.select("program_id", "src")).where("src != dst").collect()
    assert {(r["src"], r["dst"]): len(r["path"]) - 1 for r in paths} == {k: v for k, v in reach.items() if k[0] != k[1]}
    assert {r["node"] for r in graph.on_cycles(df).collect()} == {a for a, b in reach if a == b}
    part = {}
    for x in {n for e in edges for n in e}:
        group, todo = {x}, [x]
        while todo:
            y = todo.pop()
            new = {b for a, b in edges if a == y} | {a for a, b in edges if b == y}
            todo += new - group
            group |= new
        part[x] = min(group)
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == part


def test_depths_follow_a_chain_to_its_end(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_LEVELS", 5)
    e = spark.createDataFrame([("p", f"n{k:02}", f"n{k + 1:02}") for k in range(8)], "program_id string, src string, dst string")
    assert {r["node"]: r["depth"] for r in graph.depths(e).collect()} == {f"n{k:02}": k for k in range(9)}


def test_empty_corpus(spark):
    cat = Catalog.of(programs(spark, {"p": ""}))
    assert rows(cat.edges) == [] and lineage.construction(cat).count() == 0
    assert lineage.corpus_report(cat).select(F.col("fields")).first()[0] == 0


def test_stream_of_programs(spark, tmp_path):
    from provena.streaming.arrivals import arriving, maintain

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sas").write_text("data a; set s; x = y + 1; run;")
    q = maintain(arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out" / "edges")).select("src", "dst").first() == ("s.y", "a.x")


def test_reports_of_a_corpus(spark):
    cat = Catalog.of(programs(spark, {"a": "data t; set s; x = p; y = x * 2; z = 1; run; data u; set t; y = y + 1; run;", "b": "%macro m; %do i = 1 %to 9000; data q; run; %end; %mend; %m;"}), expand_macros=True)
    assert [(r["field_id"], r["metadata"]["expression"]) for r in lineage.field_in_step(cat, 1, "y").collect()] == [("u.y", "y + 1")]
    assert [(r["position"], r["field_id"]) for r in lineage.first_inputs(cat).collect()] == [(1, "t.z")]
    assert [r["program_id"] for r in lineage.failures(cat).collect()] == ["b"]
    got = lineage.slowest(cat, 1).collect()
    assert len(got) == 1 and got[0]["parse_ms"] > 0


def test_explanations_cite_only_what_the_packet_shows(spark):
    cat = Catalog.of(programs(spark, {"a": "data t; set s; x = p; run; data u; set t; y = x * 2; run;"}))
    plain = lineage.explain(cat, "construction", "u.y").first()
    assert plain["source"] == "deterministic" and plain["answer"] == plain["deterministic"] and "u.y" in plain["packet"]
    told = lambda text: lineage.explain(cat, "construction", "u.y", spark.createDataFrame([("a", text)], "program_id string, text string")).first()
    assert told("u.y is made from T.x.")["source"] == "model"
    assert told("u.y is made from v.z.")["source"] == told("no field at all")["source"] == "deterministic"
    assert "t.x" in lineage.explain(cat, "downstream", "t.x").first()["packet"]


def test_console_lines():
    from provena.cli import _lines

    assert _lines([{"a": 1, "b": [1, 2]}, {"c": [{"d": 2}]}]) == ["a: 1", "b: 1, 2", "", "c:", "  d: 2"] and _lines([]) == ["nothing found"]
