"""Values at every hop of a field's construction, for any number of input rows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.compile import Env, compile_expr, kind_of
from provena.functions.registry import text
from provena.lang import expr as E
from provena.operators import lineage
from provena.operators.catalog import Catalog


def _picked(values: DataFrame, source_id: str):
    """A golden input's column: by its full name, else by its field name; empty texts count as missing."""
    by_name = {f.name.lower(): f for f in values.schema.fields}
    f = by_name.get(source_id.lower()) or by_name.get(source_id.rsplit(".", 1)[-1].lower())
    if f is None:
        return F.lit(None).cast("double"), "num"
    c, kind = F.col(f"`{f.name}`"), kind_of(f.dataType)
    if kind == "str":
        plain = F.nullif(F.trim(c), F.lit(""))
        return F.coalesce(plain.try_cast("double").cast("string"), plain), "str"
    return (c.cast("double") if kind == "num" else c), kind


def value_trace(cat: Catalog, program_id: str, field_id: str, values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hop, node, field, value, value_text, expr): a row per input row and hop, sources first.

    Fields are kept apart by table and name.  Only the field's own chain, a handful
    of rows about one program, comes to the driver; an unknown field has no rows.
    """
    mine = F.col("program_id") == program_id
    chain = lineage.hops(cat, field_id).where(mine).orderBy("hop").collect()
    ids = [h["hop_field"] for h in chain]
    d = cat.definitions.select("program_id", "field_id", "step_idx", "stmt_idx")
    deps = cat.resolved.where(mine & F.col("field_id").isin(ids)).join(d, ["program_id", "field_id", "step_idx", "stmt_idx"]).select("field_id", "dep_name", "source_id").collect()
    source = {(r["field_id"], r["dep_name"].lower()): r["source_id"] for r in deps}
    out, made, hops = values, {}, []
    for k, h in enumerate(chain):
        own = {name: made.get(s) or _picked(values, s) for (f, name), s in source.items() if f == h["hop_field"]}
        expression = h["expression"] if h["expression"] is not None else h["name"]
        try:
            value = compile_expr(E.parse(expression), Env(own))
        except E.SyntaxProblem:
            value = F.lit(None).cast("double"), "num"
        c = F.coalesce(value[0], F.lit(False)).cast("double") if value[1] == "bool" else value[0]
        kind = "num" if value[1] == "bool" else value[1]
        out = out.withColumn(f"__v{k}", c)
        made[h["hop_field"]] = F.col(f"__v{k}"), kind
        hops.append(F.struct(
            F.lit(k + 1).alias("hop"), F.lit(h["node"]).alias("node"), F.lit(h["name"]).alias("field"),
            (F.col(f"__v{k}") if kind == "num" else F.lit(None)).cast("double").alias("value"),
            F.coalesce(text((F.col(f"__v{k}"), kind)), F.lit("")).alias("value_text"), F.lit(expression).alias("expr"),
        ))
    key_columns: list[Column] = [F.col(k) for k in keys]
    if not hops:
        return values.where("false").select(*key_columns, F.lit(0).alias("hop"), *[F.lit("").alias(c) for c in ("node", "field")], F.lit(0.0).alias("value"), F.lit("").alias("value_text"), F.lit("").alias("expr"))
    return out.select(*key_columns, F.explode(F.array(*hops)).alias("h")).select(*key_columns, "h.*")
