"""Program texts to lineage tables.

One Python pass per program parses it (and expands its macros); everything after
that is DataFrame work keyed by program_id, so that a corpus of any number of
programs is handled like one.
"""

from __future__ import annotations

import os
import time
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DEP = pa.struct([("name", pa.string()), ("table", pa.string())])
_STEP = pa.struct([
    ("step_idx", pa.int32()), ("kind", pa.string()), ("proc_name", pa.string()), ("output_table", pa.string()), ("source_line", pa.int32()),
    ("where_clause", pa.string()), ("inputs", pa.list_(pa.string())), ("keys", pa.list_(pa.string())),
])
_FIELD = pa.struct([
    ("step_idx", pa.int32()), ("stmt_idx", pa.int32()), ("name", pa.string()), ("table", pa.string()), ("operation", pa.string()), ("expression", pa.string()),
    ("source_line", pa.int32()), ("problem", pa.string()), ("deps", pa.list_(_DEP)), ("controls", pa.list_(_DEP)),
])
_SCHEMA = (
    "program_id string, path string, bytes long, lines long, status string, error string, parse_ms double, "
    "steps array<struct<step_idx:int,kind:string,proc_name:string,output_table:string,source_line:int,where_clause:string,inputs:array<string>,keys:array<string>>>, "
    "defs array<struct<step_idx:int,stmt_idx:int,name:string,table:string,operation:string,expression:string,source_line:int,problem:string,"
    "deps:array<struct<name:string,table:string>>,controls:array<struct<name:string,table:string>>>>"
)


def ship(spark) -> None:
    """Let Python workers import this package even where only the driver's sys.path has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def _name(table) -> str:
    return table.lib or table.name


def _described(code: str, expand_macros: bool, include_base):
    """(steps, fields, what kept its macros from being expanded) of a program as plain rows."""
    from provena.lang.parser import parse

    steps, fields = [], []
    program = parse(code, expand_macros, include_base)
    for k, s in enumerate(program.steps):
        outputs = [t for t in s.outputs if t.name.lower() != "_null_"]
        steps.append({
            "step_idx": k, "kind": s.kind, "proc_name": s.proc, "output_table": _name(outputs[0]) if outputs else None, "source_line": s.line,
            "where_clause": s.where, "inputs": [_name(t) for t in s.inputs], "keys": s.keys,
        })
        for f in s.fields:
            pairs = lambda x: [{"name": n, "table": t} for n, t in x]
            fields.append({
                "step_idx": k, "stmt_idx": f.stmt, "name": f.name, "table": f.table, "operation": f.operation, "expression": f.expression,
                "source_line": f.line, "problem": f.problem, "deps": pairs(f.deps), "controls": pairs(f.controls),
            })
    return steps, fields, program.fallback


def parse_programs(df: DataFrame, expand_macros: bool = False, include_base=None) -> DataFrame:
    """A row per program (program_id, path, code): its status and its steps and definitions, nested.

    A program that can't be parsed has status PARSE_ERROR and its error; one whose macros can't be
    expanded is read as it stands, with status NOT_EXPANDED and the reason.  Neither stops the others.
    """
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("bytes", "lines", "status", "error", "parse_ms", "steps", "defs")}
            for code in b.column("code").to_pylist():
                code = code or ""
                steps, defs, status, error, began = [], [], "OK", None, time.perf_counter()
                try:
                    steps, defs, error = _described(code, expand_macros, include_base)
                    status = "OK" if error is None else "NOT_EXPANDED"
                except Exception as e:  # one bad program must not fail a corpus
                    status, error = "PARSE_ERROR", f"{type(e).__name__}: {e}"
                for k, v in (("bytes", len(code.encode("utf-8", "replace"))), ("lines", code.count("\n") + 1), ("status", status), ("error", error), ("parse_ms", 1000 * (time.perf_counter() - began)), ("steps", steps), ("defs", defs)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("program_id"), b.column("path"), pa.array(out["bytes"], pa.int64()), pa.array(out["lines"], pa.int64()), pa.array(out["status"], pa.string()),
                 pa.array(out["error"], pa.string()), pa.array(out["parse_ms"], pa.float64()), pa.array(out["steps"], pa.list_(_STEP)), pa.array(out["defs"], pa.list_(_FIELD))],
                ["program_id", "path", "bytes", "lines", "status", "error", "parse_ms", "steps", "defs"],
            )

    return df.select("program_id", "path", "code").mapInArrow(run, _SCHEMA)


class Catalog:
    """The relational model of a corpus of programs.

    `fold_case` compares names without regard to case, as the language does; by
    default names compare as they are written.
    """

    def __init__(self, parsed: DataFrame, fold_case: bool = False, all_definitions: bool = False):
        self.parsed = parsed.persist()
        self.fold, self.all_definitions = fold_case, all_definitions

    @classmethod
    def of(cls, programs: DataFrame, expand_macros: bool = False, include_base=None, **options) -> Catalog:
        return cls(parse_programs(programs, expand_macros, include_base), **options)

    def _same(self, c):
        return F.lower(c) if self.fold else c

    @cached_property
    def programs(self) -> DataFrame:
        steps = lambda kind: F.size(F.filter("steps", lambda s: s["kind"] == kind)).cast("long")
        return self.parsed.select("program_id", "path", "bytes", "lines", "status", "error", "parse_ms", steps("data").alias("data_steps"), steps("proc").alias("proc_steps"))

    @cached_property
    def steps(self) -> DataFrame:
        return self.parsed.select("program_id", F.explode("steps").alias("s")).select("program_id", "s.*")

    @cached_property
    def step_inputs(self) -> DataFrame:
        return self.steps.select("program_id", "step_idx", "kind", "output_table", F.posexplode("inputs").alias("pos", "table"))

    @cached_property
    def step_keys(self) -> DataFrame:
        return self.steps.select("program_id", "step_idx", F.posexplode("keys").alias("pos", "key"))

    @cached_property
    def fields(self) -> DataFrame:
        """Every assignment: a row per definition of a field."""
        return self.parsed.select("program_id", F.explode("defs").alias("f")).select(
            "program_id", "f.step_idx", "f.stmt_idx", F.concat_ws(".", "f.table", "f.name").alias("field_id"), "f.table", "f.name", "f.operation",
            "f.expression", "f.source_line", "f.problem", "f.deps", "f.controls",
        )

    @cached_property
    def field_deps(self) -> DataFrame:
        """Every reference of an assignment, those of the conditions around it last."""
        every = F.concat(F.transform("deps", lambda d: F.struct(d["name"].alias("name"), d["table"].alias("table"), F.lit(False).alias("control"))),
                         F.transform("controls", lambda d: F.struct(d["name"].alias("name"), d["table"].alias("table"), F.lit(True).alias("control"))))
        return self.fields.select("program_id", "step_idx", "stmt_idx", "field_id", F.posexplode(every).alias("pos", "d")).select(
            "program_id", "step_idx", "stmt_idx", "field_id", "pos", F.col("d.name").alias("dep_name"), F.col("d.table").alias("dep_table"), F.col("d.control").alias("control")
        )

    @cached_property
    def definitions(self) -> DataFrame:
        """The first definition of each field."""
        first = F.min(F.struct("step_idx", "stmt_idx", "name", "table", "expression", "source_line", "operation", "problem"))
        return self.fields.groupBy("program_id", "field_id").agg(first.alias("d")).select("program_id", "field_id", "d.*")

    @cached_property
    def resolved(self) -> DataFrame:
        """Every reference with the field that it reads: source_id, and whether a definition was found.

        Among definitions of the name up to the step: the first in an earlier step
        that writes one of this step's inputs, else the last in any earlier step,
        else the last in the step itself, else the input table's own column.
        """
        uses = self.field_deps.withColumn("k", self._same(F.col("dep_name")))
        defs = self.fields.select(
            "program_id", self._same(F.col("name")).alias("k"), F.col("step_idx").alias("d_step"), F.col("stmt_idx").alias("d_stmt"),
            F.col("field_id").alias("d_id"), self._same(F.col("table")).alias("d_table"),
        )
        reads = self.steps.select("program_id", "step_idx", F.transform("inputs", self._same).alias("reads"), F.get("inputs", F.lit(0)).alias("first_input"))
        earlier = F.col("d_step") < F.col("step_idx")
        prio = F.when(earlier & F.array_contains("reads", F.col("d_table")), 0).when(earlier, 1).otherwise(2)
        sign = F.when(prio == 0, 1).otherwise(-1)
        found = uses.join(reads, ["program_id", "step_idx"]).join(defs, ["program_id", "k"], "left")
        usable = F.col("d_step") <= F.col("step_idx")
        best = F.min(F.when(usable, F.struct(prio.alias("p"), (sign * F.col("d_step")).alias("s"), (sign * F.col("d_stmt")).alias("t"), F.col("d_id").alias("id"))))
        keys = ["program_id", "step_idx", "stmt_idx", "field_id", "pos", "dep_name", "dep_table", "control", "first_input"]
        return found.groupBy(*keys).agg(best.alias("b")).select(
            *keys[:-1], F.coalesce("b.id", F.concat_ws(".", F.coalesce("dep_table", "first_input"), "dep_name")).alias("source_id"), F.col("b").isNotNull().alias("defined")
        )

    @cached_property
    def edges(self) -> DataFrame:
        """(program_id, src, dst, formula, defined): what each field is made of, by resolved references."""
        d = self.definitions.select("program_id", "field_id", F.col("step_idx").alias("ds"), F.col("stmt_idx").alias("dt"), "name", "expression")
        on_first = F.lit(True) if self.all_definitions else (F.col("step_idx") == F.col("ds")) & (F.col("stmt_idx") == F.col("dt"))
        formula = F.when(F.col("expression").isNull(), F.lit("passthrough")).otherwise(F.concat_ws(" = ", "name", "expression"))
        return (
            self.resolved.join(d, ["program_id", "field_id"]).where(on_first & (F.col("source_id") != F.col("field_id")))
            .groupBy("program_id", F.col("source_id").alias("src"), F.col("field_id").alias("dst")).agg(F.first(formula).alias("formula"), F.max("defined").alias("defined"))
        )

    @cached_property
    def edges_raw(self) -> DataFrame:
        """(program_id, src, dst): references as they are written, by the table that the text suggests."""
        return self.field_deps.select("program_id", F.concat_ws(".", "dep_table", "dep_name").alias("src"), F.col("field_id").alias("dst")).distinct()

    @cached_property
    def table_edges(self) -> DataFrame:
        """(program_id, src, dst), one for each input of each step that writes a table."""
        return self.step_inputs.where(F.col("output_table").isNotNull()).select("program_id", F.col("table").alias("src"), F.col("output_table").alias("dst"))

    @cached_property
    def tables(self) -> DataFrame:
        """(program_id, table): all tables written or read."""
        written = self.steps.where(F.col("output_table").isNotNull()).select("program_id", F.col("output_table").alias("table"))
        return written.union(self.step_inputs.select("program_id", "table")).distinct()
