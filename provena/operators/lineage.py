"""Questions to a catalogue: find, browse, trace, impact, layers, exports.

Every function returns a DataFrame over all programs of the catalogue; a question
about one field names it by its id (table.name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.operators import graph
from provena.operators.catalog import Catalog

#: Names of layers and registers by column, and what stands for the rest.
LAYERS = [("Golden sources", "Systems of record"), ("Landing", "Raw ingestion"), ("Curated", "Standardised registers"), ("Marts", "Integrated"), ("Reporting", "Consumption")]
REGISTERS = ["Golden Source", "Landing Zone", "Curated Register", "Integrated Marts", "Reporting Register"]
MAX_FLOWS = 10
#: What a text cites: a table's name, a point, and a field's.
CITED = r"[A-Za-z_]\w*\.[A-Za-z_]\w*"


def _by_column(c: Column, names: list[str], rest: Column) -> Column:
    return F.when(c < len(names), F.get(F.array(*map(F.lit, names)), c)).otherwise(rest)


# --- fields ------------------------------------------------------------------


def find_field(cat: Catalog, name: str, table: str | None = None) -> DataFrame:
    """All assignments of a field."""
    same = cat._same(F.col("name")) == cat._same(F.lit(name))
    out = cat.fields.where(same)
    return out if table is None else out.where(cat._same(F.col("table")) == cat._same(F.lit(table)))


def field_in_step(cat: Catalog, step_idx: int, name: str) -> DataFrame:
    """The assignments of a field in one step of each program, with what is known of them as a map."""
    known = F.map_filter(F.create_map(*[x for c in ("operation", "expression", "problem") for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    return find_field(cat, name).where(F.col("step_idx") == step_idx).withColumn("metadata", known)


def first_inputs(cat: Catalog, n: int = 10) -> DataFrame:
    """(program_id, position, field_id, table, name): the first n fields of each program that read no other, in order of their statements."""
    plain = cat.fields.where(F.col("expression").isNull() | (F.size("deps") + F.size("controls") == 0))
    order = W.partitionBy("program_id").orderBy("step_idx", "stmt_idx")
    return plain.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n).select("program_id", "position", "field_id", "table", "name")


def all_fields(cat: Catalog) -> DataFrame:
    """All assignments with `ord`, which keeps assignments of one name together, names by first appearance."""
    at = F.struct("step_idx", "stmt_idx")
    first = cat.fields.groupBy("program_id", "name").agg(F.min(at).alias("first"))
    return cat.fields.join(first, ["program_id", "name"]).withColumn("ord", F.struct("first", at)).drop("first")


def field_record(cat: Catalog) -> DataFrame:
    """(program_id, field_id, name, table, operation, expression, dependencies, source_line): names only of dependencies."""
    return cat.fields.select("program_id", "field_id", "name", "table", "operation", "expression", F.transform("deps", lambda d: d["name"]).alias("dependencies"), "source_line")


def browse_fields(cat: Catalog, table: str | None = None) -> DataFrame:
    """(program_id, table, n_fields, fields): the fields of each table, by name."""
    rows = cat.fields if table is None else cat.fields.where(F.col("table") == table)
    return rows.groupBy("program_id", F.coalesce("table", F.lit("unknown")).alias("table")).agg(
        F.count("*").alias("n_fields"), F.sort_array(F.collect_list("name")).alias("fields")
    )


def browse_stats(cat: Catalog, table: str | None = None) -> DataFrame:
    """Counts of fields, of tables that own fields, of fields with references, and the greatest depth by direct references."""
    rows = cat.fields if table is None else cat.fields.where(F.col("table") == table)
    has = F.size("deps") + F.size("controls") > 0
    return rows.groupBy("program_id").agg(
        F.count("*").alias("total_fields"), F.count_distinct(F.coalesce("table", F.lit("unknown"))).alias("total_tables"),
        F.count_if(has).alias("fields_with_dependencies"), F.max(F.when(has, 1).otherwise(0)).cast("long").alias("max_depth"),
    )


def query_field(cat: Catalog, name: str, table: str | None = None, direct: bool = False) -> DataFrame:
    """A row per assignment of a field: record, upstream and downstream ids, depth; found = false and a message if there is none."""
    hits = find_field(cat, name, table)
    ids = hits.select("program_id", F.col("field_id").alias("src")).distinct()
    edges = cat.edges_raw if direct else cat.edges
    down = graph.reach(edges, ids).groupBy("program_id", F.col("src").alias("field_id")).agg(F.array_sort(F.collect_set("dst")).alias("downstream"))
    back = edges.select("program_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    up_rows = back.join(ids, ["program_id", "src"]) if direct else graph.reach(back, ids)
    up = up_rows.groupBy("program_id", F.col("src").alias("field_id")).agg(F.array_sort(F.collect_set("dst")).alias("upstream"))
    depth = graph.depths(cat.edges).select("program_id", F.col("node").alias("field_id"), "depth")
    none = F.array().cast("array<string>")
    found = (
        hits.select("program_id", "field_id", "name", "table", "expression", "source_line").join(up, ["program_id", "field_id"], "left")
        .join(down, ["program_id", "field_id"], "left").join(depth, ["program_id", "field_id"], "left")
        .select("program_id", "field_id", "name", "table", "expression", "source_line", F.coalesce("upstream", none).alias("upstream"),
                F.coalesce("downstream", none).alias("downstream"), F.coalesce("depth", F.lit(0)).alias("depth"), F.lit(True).alias("found"), F.lit(None).cast("string").alias("message"))
    )
    missing = cat.programs.select("program_id").join(ids.select("program_id").distinct(), "program_id", "left_anti").select(
        "program_id", F.lit(None).cast("string").alias("field_id"), F.lit(name).alias("name"), F.lit(table).cast("string").alias("table"), F.lit(None).cast("string").alias("expression"),
        F.lit(None).cast("int").alias("source_line"), none.alias("upstream"), none.alias("downstream"), F.lit(0).alias("depth"), F.lit(False).alias("found"), F.lit("Field not found").alias("message"),
    )
    return found.unionByName(missing)


def all_tables(cat: Catalog) -> DataFrame:
    return cat.tables


# --- closures ------------------------------------------------------------------


def _start(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("src") == node) | (F.col("dst") == node)).select("program_id").distinct().withColumn("src", F.lit(node))


def upstream_direct(cat: Catalog) -> DataFrame:
    """(program_id, field_id, source_id): references of each field, resolved, one step."""
    return cat.edges.select("program_id", F.col("dst").alias("field_id"), F.col("src").alias("source_id"))


def upstream(cat: Catalog, field_id: str | None = None) -> DataFrame:
    """(program_id, field_id, source_id, distance): everything that a field, or every field, is made of."""
    back = graph.reverse(cat.edges)
    rows = graph.reach(back, None if field_id is None else _start(back, field_id))
    return rows.select("program_id", F.col("src").alias("field_id"), F.col("dst").alias("source_id"), "distance")


def downstream(cat: Catalog, field_id: str | None = None) -> DataFrame:
    """(program_id, field_id, target_id, distance): everything that uses a field."""
    rows = graph.reach(cat.edges, None if field_id is None else _start(cat.edges, field_id))
    return rows.select("program_id", F.col("src").alias("field_id"), F.col("dst").alias("target_id"), "distance")


def depth(cat: Catalog) -> DataFrame:
    """(program_id, field_id, depth): longest chain of definitions and inputs below each field."""
    return graph.depths(cat.edges).select("program_id", F.col("node").alias("field_id"), "depth")


def path(cat: Catalog, source_id: str, target_id: str) -> DataFrame:
    """(program_id, path, hops): a shortest path by which the source enters the target; no row if it doesn't."""
    if source_id == target_id:
        return graph.shortest_paths(cat.edges, _start(cat.edges, source_id)).where("false").select("program_id", "path", F.lit(0).alias("hops"))
    found = graph.shortest_paths(cat.edges, _start(cat.edges, source_id)).where(F.col("dst") == target_id)
    return found.select("program_id", "path", (F.size("path") - 1).alias("hops"))


def affected(cat: Catalog, field_id: str, other_id: str) -> DataFrame:
    """(program_id, affected, path, answer) for each program that defines the field and knows the other one."""
    known = cat.definitions.where(F.col("field_id") == field_id).select("program_id")
    nodes = cat.edges.select("program_id", F.col("src").alias("id")).union(cat.definitions.select("program_id", F.col("field_id").alias("id")))
    both = known.join(nodes.where(F.col("id") == other_id).select("program_id").distinct(), "program_id")
    way = path(cat, other_id, field_id)
    yes = F.concat(F.lit(f"YES. {field_id} is affected by {other_id} via: "), F.array_join("path", " -> "), F.lit("."))
    return both.join(way, "program_id", "left").select(
        "program_id", F.col("path").isNotNull().alias("affected"), "path", F.coalesce(yes, F.lit(f"NO. {field_id} is not built from {other_id}.")).alias("answer")
    )


def golden_inputs(cat: Catalog) -> DataFrame:
    """(program_id, field_id): inputs that no step defines."""
    return cat.edges.where(~F.col("defined")).select("program_id", F.col("src").alias("field_id")).distinct()


def terminal_fields(cat: Catalog) -> DataFrame:
    """(program_id, field_id): fields that nothing uses."""
    used = cat.edges.select("program_id", F.col("src").alias("field_id"))
    return cat.definitions.select("program_id", "field_id").join(used, ["program_id", "field_id"], "left_anti")


# --- construction ----------------------------------------------------------------


def hops(cat: Catalog, field_id: str | None = None) -> DataFrame:
    """The construction of a field, or of every field: (program_id, field_id, hop, hop_field, node, name, expression, inputs).

    Hops are the defined fields below it and itself, numbered so that each comes
    after all that it is made of: by depth, then by place in the program.
    """
    up = upstream(cat, field_id).select("program_id", "field_id", F.col("source_id").alias("hop_field"))
    own = cat.definitions.select("program_id", "field_id", F.col("field_id").alias("hop_field"))
    if field_id is not None:
        own = own.where(F.col("field_id") == field_id)
    d = cat.definitions.select("program_id", F.col("field_id").alias("hop_field"), F.col("table").alias("node"), "name", "expression", "step_idx", "stmt_idx")
    level = depth(cat).withColumnRenamed("field_id", "hop_field")
    ins = cat.edges.groupBy("program_id", F.col("dst").alias("hop_field")).agg(F.array_sort(F.collect_set("src")).alias("inputs"))
    rows = own.union(up).distinct().join(d, ["program_id", "hop_field"]).join(level, ["program_id", "hop_field"], "left").join(ins, ["program_id", "hop_field"], "left")
    order = W.partitionBy("program_id", "field_id").orderBy(F.coalesce("depth", F.lit(0)), "step_idx", "stmt_idx")  # a field's hops: a window of one program
    return rows.select(
        "program_id", "field_id", F.row_number().over(order).alias("hop"), "hop_field", "node", "name", "expression",
        F.coalesce("inputs", F.array().cast("array<string>")).alias("inputs"),
    )


def _inputs_of(cat: Catalog, field_id: str | None = None) -> DataFrame:
    golden = golden_inputs(cat).withColumnRenamed("field_id", "source_id")
    return upstream(cat, field_id).join(golden, ["program_id", "source_id"]).groupBy("program_id", "field_id").agg(F.array_sort(F.collect_set("source_id")).alias("golden_inputs"))


def construction(cat: Catalog, field_id: str | None = None) -> DataFrame:
    """(program_id, field_id, hops, golden_inputs, answer): the packet of facts and its plain English."""
    one = F.struct("hop", F.col("hop_field").alias("field"), F.col("expression").alias("expr"), "inputs")
    grouped = hops(cat, field_id).groupBy("program_id", "field_id").agg(F.array_sort(F.collect_list(one)).alias("hops"))
    rows = grouped.join(_inputs_of(cat, field_id), ["program_id", "field_id"], "left").withColumn("golden_inputs", F.coalesce("golden_inputs", F.array().cast("array<string>")))

    def line(h: Column) -> Column:
        made = F.when(h["expr"].isNull(), F.concat(h["field"], F.lit(" carried through unchanged"))).otherwise(F.concat(h["field"], F.lit(" = "), h["expr"]))
        origin = F.when(F.size(h["inputs"]) == 0, F.lit("nothing (source field)")).otherwise(F.array_join(h["inputs"], ", "))
        return F.concat(h["hop"].cast("string"), F.lit(". "), made, F.lit(" (from "), origin, F.lit(")"))

    golden = F.when(F.size("golden_inputs") == 0, F.lit("none")).otherwise(F.array_join("golden_inputs", ", "))
    text = F.concat(F.lit("Construction trace of "), F.col("field_id"), F.lit(":\n"), F.array_join(F.transform("hops", line), "\n"), F.lit("\nGolden inputs: "), golden, F.lit("."))
    return rows.withColumn("answer", text)


def impact(cat: Catalog, field_id: str | None = None) -> DataFrame:
    """(program_id, field_id, flows, flows_truncated, all_downstream, terminal_fields, answer): what a field, or every field and input, flows into.

    At most ten direct flows are listed, by target; the rest are counted.
    """
    nodes = cat.definitions.select("program_id", "field_id").union(cat.edges.select("program_id", F.col("src").alias("field_id"))).distinct()
    if field_id is not None:
        nodes = nodes.where(F.col("field_id") == field_id)
    direct = cat.edges.groupBy("program_id", F.col("src").alias("field_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("dst").alias("to"), "formula"))).alias("flows"))
    ends = terminal_fields(cat).withColumnRenamed("field_id", "target_id").withColumn("end", F.lit(True))
    far = downstream(cat, field_id).where("field_id != target_id").join(ends, ["program_id", "target_id"], "left").groupBy("program_id", "field_id").agg(
        F.array_sort(F.collect_set("target_id")).alias("all_downstream"), F.array_sort(F.collect_set(F.when(F.col("end"), F.col("target_id")))).alias("terminal_fields")
    )
    none = F.array().cast("array<string>")
    rows = nodes.join(direct, ["program_id", "field_id"], "left").join(far, ["program_id", "field_id"], "left").select(
        "program_id", "field_id", F.slice("flows", 1, MAX_FLOWS).alias("flows"), F.greatest(F.coalesce(F.size("flows"), F.lit(0)) - MAX_FLOWS, F.lit(0)).alias("flows_truncated"),
        F.coalesce("all_downstream", none).alias("all_downstream"), F.coalesce("terminal_fields", none).alias("terminal_fields"),
    )
    listed = F.array_join(F.transform("flows", lambda f: F.concat(F.lit("- "), f["to"], F.lit(" ("), f["formula"], F.lit(")"))), "\n")
    more = F.when(F.col("flows_truncated") > 0, F.concat(F.lit("\n- and "), F.col("flows_truncated").cast("string"), F.lit(" more fields."))).otherwise("")
    ends_text = F.when(F.size("terminal_fields") == 0, F.col("field_id")).otherwise(F.array_join("terminal_fields", ", "))
    text = F.concat(F.col("field_id"), F.lit(" flows into:\n"), listed, more, F.lit("\nTerminal fields: "), ends_text, F.lit("."))
    return rows.withColumn("answer", F.when(F.col("flows").isNull(), F.concat(F.lit("No downstream use: "), F.col("field_id"), F.lit(" is terminal."))).otherwise(text))


def packet(kind: str, rows: DataFrame) -> DataFrame:
    """(program_id, field_id, packet): facts of construction() or impact() as JSON, without the answer."""
    facts = [c for c in rows.columns if c not in ("program_id", "answer", "field_id")]
    return rows.select("program_id", "field_id", F.to_json(F.struct(F.lit(kind).alias("kind"), F.col("field_id").alias("field"), *facts)).alias("packet"))


def universe(rows: DataFrame) -> DataFrame:
    """(program_id, field_id, ids): every id that a packet of construction() or impact() shows."""
    if "hops" in rows.columns:
        ids = F.array_union(F.array_union(F.array("field_id"), F.transform("hops", lambda h: h["field"])), F.array_union(F.flatten(F.transform("hops", lambda h: h["inputs"])), F.col("golden_inputs")))
    else:
        to = F.coalesce(F.transform("flows", lambda f: f["to"]), F.array().cast("array<string>"))
        ids = F.array_union(F.array_union(F.array("field_id"), to), F.array_union(F.col("all_downstream"), F.col("terminal_fields")))
    return rows.select("program_id", "field_id", F.array_sort(F.array_distinct(ids)).alias("ids"))


def cites_only(cited: Column, known: Column) -> Column:
    """True if an answer cites something, and nothing outside what is known, whatever the case."""
    low = lambda a: F.transform(a, lambda x: F.lower(x))
    return (F.size(cited) > 0) & (F.size(F.array_except(low(cited), low(known))) == 0)


def explain(cat: Catalog, kind: str, field_id: str, said: DataFrame | None = None) -> DataFrame:
    """(program_id, field_id, packet, deterministic, answer, source): a field's packet and its rendered answer, or a text model's if it cites only what the packet shows.

    `kind` is construction or downstream; `said` holds the model's texts as (program_id, text), where there are any.
    """
    rows = (construction if kind == "construction" else impact)(cat, field_id)
    facts = packet(kind, rows).join(universe(rows), ["program_id", "field_id"]).join(rows.select("program_id", "field_id", F.col("answer").alias("deterministic")), ["program_id", "field_id"])
    if said is None:
        return facts.select("program_id", "field_id", "packet", "deterministic", F.col("deterministic").alias("answer"), F.lit("deterministic").alias("source"))
    told = facts.join(said.select("program_id", "text"), "program_id", "left")
    good = F.col("text").isNotNull() & cites_only(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(CITED), F.lit(0)), F.col("ids"))
    return told.select(
        "program_id", "field_id", "packet", "deterministic", F.when(good, F.col("text")).otherwise(F.col("deterministic")).alias("answer"),
        F.when(good, "model").otherwise("deterministic").alias("source"),
    )


# --- tables and layers --------------------------------------------------------------


def layers(cat: Catalog) -> DataFrame:
    """(program_id, table, col, row): the longest way from a source table, and the place by name within that column."""
    d = graph.depths(cat.table_edges).select("program_id", F.col("node").alias("table"), F.col("depth").alias("col"))
    rows = cat.tables.join(d, ["program_id", "table"], "left").withColumn("col", F.coalesce("col", F.lit(0)))
    return rows.withColumn("row", F.row_number().over(W.partitionBy("program_id", "col").orderBy("table")) - 1)


def golden_tables(cat: Catalog) -> DataFrame:
    """(program_id, table): tables that no step writes from another."""
    written = cat.table_edges.select("program_id", F.col("dst").alias("table"))
    return cat.tables.join(written, ["program_id", "table"], "left_anti")


def nodes(cat: Catalog) -> DataFrame:
    """The record of each table for a layered picture."""
    per_step = cat.fields.groupBy("program_id", "table", "step_idx").count()
    counts = per_step.groupBy("program_id", "table").agg(F.max("count").alias("n"))
    golden = golden_tables(cat).withColumn("golden", F.lit(True))
    c = F.col("col")
    rows = layers(cat).join(golden, ["program_id", "table"], "left").join(counts, ["program_id", "table"], "left").withColumn("golden", F.coalesce("golden", F.lit(False)))
    return rows.select(
        "program_id", F.col("table").alias("id"), F.upper("table").alias("name"),
        F.when(F.col("golden"), "Golden source").when(c == 0, "SAS pipeline · staged").otherwise("SAS job").alias("system"), "col", "row",
        _by_column(c, REGISTERS, F.concat(F.lit("Register "), (c + 1).cast("string"))).alias("register"),
        _by_column(c, [a for a, _ in LAYERS], F.concat(F.lit("Layer "), (c + 1).cast("string"))).alias("layer"),
        _by_column(c, [b for _, b in LAYERS], F.lit("Transform stage")).alias("kicker"), "golden",
        F.when(F.col("golden"), "Golden source owner").otherwise("Pipeline owner").alias("steward"), F.when(F.col("golden"), "Near real time").otherwise("Batch run").alias("refresh"),
        F.coalesce("n", F.lit(0)).cast("long").alias("field_count"),
    )


def registers(cat: Catalog) -> DataFrame:
    """(program_id, registers): names of the columns in use, sources first."""
    rows = nodes(cat).select("program_id", "col", "register").distinct()
    return rows.groupBy("program_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "register"))), lambda x: x["register"]).alias("registers"))


def dtype_label(expression: Column) -> Column:
    """A label of a value's type, from its expression."""
    e = F.coalesce(expression, F.lit(""))
    return F.when(e.rlike("(?i)SUM|MEAN|MAX|MIN") | e.rlike("[-+*/]"), "DECIMAL(18,2)").when(e.rlike("['\"]"), "VARCHAR(140)").otherwise("N/A")


def field_traces(cat: Catalog) -> DataFrame:
    """The record of each field: type label, job labels, golden tables, inputs and steps."""
    last = F.max("hop").over(W.partitionBy("program_id", "field_id"))
    job = F.concat(F.when(F.col("hop") == last, F.lit("build_")).otherwise(F.lit("stage_")), F.lower("node"))
    made = F.when(F.col("expression").isNull(), F.lit("Passthrough field (carried unchanged).")).otherwise(F.concat_ws(" = ", "name", "expression"))
    steps = hops(cat).withColumn("job", job).withColumn("transform", made).groupBy("program_id", "field_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("hop", "node", F.col("name").alias("field"), "transform", "job"))), lambda s: F.struct(s["node"], s["field"], s["transform"], s["job"])).alias("steps")
    )
    ins = _inputs_of(cat)
    gold = golden_tables(cat).withColumn("g", F.lit(True))
    tables = ins.select("program_id", "field_id", F.explode("golden_inputs").alias("x")).select("program_id", "field_id", F.regexp_extract("x", r"^(.*)\.", 1).alias("table"))
    golden = tables.join(gold, ["program_id", "table"]).groupBy("program_id", "field_id").agg(F.array_sort(F.collect_set(F.upper("table"))).alias("golden"))
    keys = ["program_id", "field_id"]
    return cat.definitions.join(steps, keys).join(ins, keys, "left").join(golden, keys, "left").select(
        "program_id", "field_id", "name", F.col("table").alias("node"), dtype_label(F.col("expression")).alias("dtype"), F.concat(F.col("table"), F.lit(" steward")).alias("owner"),
        F.coalesce("golden", F.array(F.lit("Golden source"))).alias("golden"), F.coalesce("golden_inputs", F.array().cast("array<string>")).alias("inputs"), "steps",
    )


def stats(cat: Catalog) -> DataFrame:
    """(program_id, traced_fields, golden_sources, registers, datasets)."""
    n = nodes(cat).groupBy("program_id").agg(F.count_if("golden").alias("golden_sources"), F.count_distinct("register").alias("registers"), F.count("*").alias("datasets"))
    f = cat.definitions.groupBy("program_id").agg(F.count("*").alias("traced_fields"))
    return n.join(f, "program_id", "left").select("program_id", F.coalesce("traced_fields", F.lit(0)).alias("traced_fields"), "golden_sources", "registers", "datasets")


def payload(cat: Catalog) -> DataFrame:
    """(program_id, payload): nodes, edges, registers, fields and counts of a program as one JSON text."""
    n = nodes(cat)
    all_nodes = n.groupBy("program_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in n.columns if c != "program_id"]))).alias("N"))
    e = cat.table_edges.groupBy("program_id").agg(F.sort_array(F.collect_list(F.array("src", "dst"))).alias("E"))
    f = field_traces(cat)
    fields = f.groupBy("program_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in f.columns if c != "program_id"]))).alias("F"))
    s = stats(cat)
    counts = s.select("program_id", F.struct(*[c for c in s.columns if c != "program_id"]).alias("stats"))
    out = all_nodes
    for part in (e, fields, registers(cat), counts):
        out = out.join(part, "program_id", "left")
    return out.select("program_id", F.to_json(F.struct("N", "E", "registers", "F", "stats")).alias("payload"))


# --- exports and statistics -----------------------------------------------------------


def dot(cat: Catalog, resolved: bool = True) -> DataFrame:
    """(program_id, dot): the field graph for Graphviz, nodes and edges by name."""
    edges = cat.edges if resolved else cat.edges_raw
    own = cat.definitions.select("program_id", F.col("field_id").alias("id"), "operation")
    ends = edges.select("program_id", F.col("src").alias("id")).union(edges.select("program_id", F.col("dst").alias("id"))).union(own.select("program_id", "id")).distinct()
    node = F.format_string('  "%s" [label="%s\\n%s"];', F.col("id"), F.col("id"), F.coalesce("operation", F.lit("source")))
    n = ends.join(own, ["program_id", "id"], "left").groupBy("program_id").agg(F.array_join(F.sort_array(F.collect_list(node)), "\n").alias("n"))
    e = edges.groupBy("program_id").agg(F.array_join(F.sort_array(F.collect_set(F.format_string('  "%s" -> "%s";', F.col("src"), F.col("dst")))), "\n").alias("e"))
    return n.join(e, "program_id", "left").select("program_id", F.concat_ws("\n", F.lit("digraph lineage {"), F.lit("  node [shape=box];"), "n", "e", F.lit("}")).alias("dot"))


def depth_histogram(cat: Catalog) -> DataFrame:
    """(program_id, depth, n_fields) over defined fields."""
    d = cat.definitions.select("program_id", "field_id").join(depth(cat), ["program_id", "field_id"], "left")
    return d.groupBy("program_id", F.coalesce("depth", F.lit(0)).alias("depth")).agg(F.count("*").alias("n_fields"))


def most_dependencies(cat: Catalog, n: int = 5) -> DataFrame:
    """The n fields of most direct sources in the whole corpus."""
    counts = cat.edges.groupBy("program_id", F.col("dst").alias("field_id")).agg(F.count("*").alias("n_sources"))
    return counts.orderBy(F.desc("n_sources"), "program_id", "field_id").limit(n)


def corpus_report(cat: Catalog) -> DataFrame:
    """One row: programs, failures, bytes, lines, steps, fields, and the deepest field."""
    p = cat.programs.agg(
        F.count("*").alias("programs"), F.count_if(F.col("status") != "OK").alias("failed"), F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"),
        F.sum("data_steps").alias("data_steps"), F.sum("proc_steps").alias("proc_steps"),
    )
    f = cat.definitions.agg(F.count("*").alias("fields"))
    d = depth(cat).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.max_by("field_id", "depth").alias("deepest"))
    return p.join(f).join(d)  # three single rows


def slowest(cat: Catalog, n: int = 5) -> DataFrame:
    """The n programs that took longest to parse."""
    return cat.programs.orderBy(F.desc("parse_ms"), "program_id").limit(n).select("program_id", "path", "bytes", "lines", "parse_ms")


def failures(cat: Catalog) -> DataFrame:
    """Programs that were not read as they should be, with the reason."""
    return cat.programs.where(F.col("status") != "OK").select("program_id", "path", "status", F.substring("error", 1, 200).alias("error"))


def topological(cat: Catalog) -> DataFrame:
    """(program_id, field_id, position): an order in which every field follows its sources."""
    order = W.partitionBy("program_id").orderBy("depth", "field_id")
    return depth(cat).select("program_id", "field_id", F.row_number().over(order).alias("position"))
