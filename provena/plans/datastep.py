"""DATA steps and procedures as DataFrame plans.

A step's statements become a chain of columns: an assignment is a projection, a
condition a guard on the assignments under it, WHERE and subsetting IF filters,
BY groups give FIRST. and LAST. flags, sum statements running sums.  Tables have
no row order here, so a step that depends on it takes `order_by` (after its BY
keys); without it, it is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.functions.compile import Env, compile_expr, truth
from provena.functions.registry import Unsupported, num, text
from provena.lang import expr as E
from provena.lang.parser import Program, Step, parse
from provena.operators.ordered import carried, lagged, running_sum

Tables = dict[str, DataFrame]

#: Statements that change no value of a row.
DECLARATIONS = {"length", "format", "informat", "label", "attrib", "put", "infile", "file", "title", "footnote", "options", "run", "quit"}


class StepError(ValueError):
    """A step that can't be planned, with the reason."""


def _named(tables: Tables, t) -> DataFrame:
    for key in ([f"{t.lib}.{t.name}".lower()] if t.lib else []) + [t.name.lower()]:
        for k, v in tables.items():
            if k.lower() == key:
                return v
    raise StepError(f"the table {t.name} is not there")


def _optioned(df: DataFrame, options: dict, strict: bool) -> DataFrame:
    """KEEP=, DROP=, RENAME= and WHERE= of a table, in that order of the language: where, keep, drop, rename."""
    low = {c.lower(): c for c in df.columns}
    if "where" in options:
        df = df.where(truth(compile_expr(E.parse(options["where"]), Env.of(df.schema), strict)))
    if "keep" in options:
        df = df.select(*[low[c.lower()] for c in options["keep"] if c.lower() in low])
    if "drop" in options:
        df = df.drop(*[low[c.lower()] for c in options["drop"] if c.lower() in low])
    for old, new in options.get("rename", []):
        df = df.withColumnRenamed(low.get(old.lower(), old), new)
    return df


def match_merge(left: DataFrame, right: DataFrame, keys: list[str], order_by: list[str] | None = None, flags: tuple = ("__in_a", "__in_b")) -> DataFrame:
    """Two tables merged by keys, row by row within each key.

    In a key's group the pth rows go together; the shorter side repeats its last
    row.  Columns that both have come from the right, where it has a row.  A null
    key is a key like any other.  Rows within a key are ordered by `order_by`, or
    else by all their columns.
    """

    own_keys = [F.col(f"`{k}`") for k in keys]

    def side(df: DataFrame, mine: str, other: str, theirs: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        by = [F.col(f"`{c}`") for c in (order_by or df.columns) if c in df.columns]
        place = F.row_number().over(W.partitionBy(*own_keys).orderBy(*(by or [F.lit(0)])))
        hold = lambda d: F.struct(F.lit(True).alias("__is"), *[F.col(f"`{c}`") for c in d.columns if c not in keys])
        empty = F.lit(None).cast(theirs.select(hold(theirs).alias("x")).schema["x"].dataType)
        return df.select(*own_keys, *[F.col(f"`{c}`") for c in rest], place.alias("__p")).select(*own_keys, "__p", hold(df).alias(mine), empty.alias(other))

    # Both sides' rows of a key and place meet in one exchange by the keys; null keys are keys like others.
    both = side(left, "__a", "__b", right).unionByName(side(right, "__b", "__a", left)).repartition(*own_keys)
    met = both.groupBy(*own_keys, "__p").agg(F.first("__a", ignorenulls=True).alias("__a"), F.first("__b", ignorenulls=True).alias("__b"))
    so_far = W.partitionBy(*own_keys).orderBy("__p").rowsBetween(W.unboundedPreceding, 0)
    out = met.select(*own_keys, "__p", *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in ("__a", "__b")])
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    a, b = (lambda c: F.col(f"__a.`{c}`")), (lambda c: F.col(f"__b.`{c}`"))
    merged = [F.when(F.col("__b").isNotNull(), b(c)).otherwise(a(c)).alias(c) if c in shared else a(c).alias(c) for c in left.columns if c not in keys]
    return out.select(
        *own_keys, *merged, *[b(c).alias(c) for c in right.columns if c not in keys and c not in shared],
        F.col("__a").isNotNull().alias(flags[0]), F.col("__b").isNotNull().alias(flags[1]), F.col("__p").alias("__place"),
    )


def update_by(master: DataFrame, changes: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """The master's rows with the changes of their key applied in order, missing values changing nothing; keys that only changes have are added.

    A key has one row in the result: the master is taken to have one row at most for each.
    """
    own = [c for c in changes.columns if c not in keys]
    order = F.struct(*[F.col(f"`{c}`") for c in (order_by or changes.columns) if c in changes.columns])
    last = changes.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), order)).alias(c) for c in own])
    out = match_merge(master, last.select(*keys, *[F.col(f"`{c}`").alias(f"__new_{c}") for c in own]), keys, None, ("__x", "__y"))
    of = lambda c: F.coalesce(F.col(f"`__new_{c}`"), F.col(f"`{c}`")) if c in master.columns else F.col(f"`__new_{c}`")
    names = [*master.columns, *[c for c in own if c not in master.columns]]
    return out.select(*[F.col(f"`{c}`") if c in keys or c not in own else of(c).alias(c) for c in names])


def concatenate(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


class _Plan:
    """One DATA step under construction."""

    def __init__(self, step: Step, tables: Tables, order_by: list[str] | None, strict: bool, problems: list):
        self.step, self.tables, self.order_by, self.strict, self.problems = step, tables, order_by, strict, problems
        self.keep: list[str] = []
        self.dropped: list[str] = []
        self.renames: list = []
        self.retained: dict = {}
        self.by = next((n[1] for n in step.body if n[0] == "by"), [])
        self.snapshots: list[tuple[DataFrame, Column, list]] = []
        self.explicit = _holds(step.body, "output")
        self.count = 0
        self.in_flags: set[str] = set()
        self.df: DataFrame | None = None

    # --- the rows that come in ---

    def source(self, spark) -> DataFrame:
        node = next((n for n in self.step.body if n[0] in ("set", "merge", "update")), None)
        if node is None:
            rows = next((n[1] for n in self.step.body if n[0] == "datalines"), None)
            columns = next((n[1] for n in self.step.body if n[0] == "input"), "")
            return _inline(spark, columns, rows) if rows is not None else spark.range(1).select()
        parts = [_optioned(_named(self.tables, t), t.options, self.strict) for t in node[1]]
        names = [str(t.options["in"]).lower() if "in" in t.options else None for t in node[1]]
        self.in_flags = {n for n in names if n}
        if node[0] == "set" or not self.by:
            if node[0] != "set":
                raise StepError(f"{node[0].upper()} without BY pairs rows by position, which tables here don't have")
            parts = [p.withColumns({n: F.lit(float(n == own)) for n in self.in_flags}) if self.in_flags else p for p, own in zip(parts, names)]
            return concatenate(parts)
        keys = [_column(parts[0], k) for k, _ in self.by]
        if node[0] == "update":
            if len(parts) != 2:
                raise StepError("UPDATE takes a master and a table of changes")
            return update_by(*parts, keys, self.order_by)
        out, flags = parts[0], {names[0]: F.lit(1.0)} if names[0] else {}
        if flags:
            out = out.withColumns(flags)
        for p, own in zip(parts[1:], names[1:]):
            out = match_merge(out, p, keys, self.order_by, ("__x", "__y"))
            for n in [x for x in names[:names.index(own) if own in names else None] if x and x in out.columns]:
                out = out.withColumn(n, F.coalesce(n, F.lit(0.0)))
            out = (out.withColumn(own, F.col("__y").cast("double")) if own else out).drop("__x", "__y", "__place")
        return out

    def env(self) -> Env:
        return Env.of(self.df.schema)

    def value(self, tree):
        if tree is None:
            if self.strict:
                raise Unsupported("an expression that can't be read")
            return F.lit(None).cast("double"), "num"
        return compile_expr(self._lags(tree), self.env(), self.strict, self.problems, self.flag)

    # --- order ---

    def _order(self, after_keys: bool = True) -> list[Column]:
        if not self.order_by:
            raise StepError("the step depends on the order of rows: give order_by")
        return [F.col(c) for c in self.order_by]

    def flag(self, which: str, key: str) -> Column:
        names = [k.lower() for k, _ in self.by]
        if key.lower() not in names:
            raise Unsupported(f"{which.upper()}.{key} without BY {key}")
        k = names.index(key.lower())
        name = f"__{which}_{names[k]}"
        if name not in self.df.columns:
            prefix = [_column(self.df, n) for n, _ in self.by[:k + 1]]
            rest = [F.col(_column(self.df, n)).desc() if d else F.col(_column(self.df, n)) for n, d in self.by[k + 1:]]
            keys = rest + self._order()
            if which == "last":
                keys = [c.desc() for c in ([F.col(_column(self.df, n)) for n, _ in self.by[k + 1:]] + self._order())]
            self.df = self.df.withColumn(name, F.row_number().over(W.partitionBy(*prefix).orderBy(*keys)) == 1)
        return F.col(name)

    def _lags(self, tree):
        """LAGn(x) of the whole table, as a column of its own."""
        if not isinstance(tree, tuple):
            return tree
        if tree and tree[0] == "call" and tree[1].startswith("lag") and (tree[1][3:] or "1").isdigit() and tree[2] and tree[2][0][0] == "name":
            self.count += 1
            name = f"__lag{self.count}"
            self._order()
            keys = [_column(self.df, k) for k, _ in self.by] + [c for c in self.order_by if c.lower() not in {k.lower() for k, _ in self.by}]
            self.df = lagged(self.df, _column(self.df, tree[2][0][1]), int(tree[1][3:] or 1), keys, name)
            return ("name", name)
        return tuple(self._lags(x) for x in tree)

    # --- statements ---

    def put(self, name: str, value, guard: Column | None) -> None:
        c, kind = value
        if kind == "bool":
            c, kind = F.coalesce(c, F.lit(False)).cast("double"), "num"
        low = {x.lower(): x for x in self.df.columns}
        target = low.get(name.lower(), name)
        if guard is not None:
            old = self.env().get(name) if name.lower() in low else (F.lit(None).cast("string" if kind == "str" else "double") if kind in ("str", "num") else F.lit(None), kind)
            if old[1] != kind and "str" in (old[1], kind):
                c, old = text((c, kind)), (text(old), "str")
            c = F.when(guard, c).otherwise(old[0])
        self.df = self.df.withColumn(target, c)

    def freeze(self, condition: Column) -> Column:
        """A condition kept as it is now, though the fields it reads may change."""
        self.count += 1
        name = f"__if{self.count}"
        self.df = self.df.withColumn(name, condition)
        return F.col(name)

    def block(self, body: list, guard: Column | None = None) -> None:
        for node in body:
            getattr(self, "do_" + node[0], self.skip)(node, guard)

    def skip(self, node, guard) -> None:
        """Declarations that change no value are passed over; any other statement without a plan is a problem."""
        if node[0] in ("set", "merge", "update", "by", "datalines", "input"):
            return
        said = node[1] if isinstance(node[1], str) else " ".join([node[0], *node[1]])
        if node[0] == "ignored" and (not said or said.split()[0].lower() in DECLARATIONS):
            return
        self.do_problem(("problem", said, "the statement has no plan"), guard)

    def do_problem(self, node, guard) -> None:
        self.problems.append(f"{node[2]}: {node[1]}")
        if self.strict:
            raise StepError(node[2])

    def do_assign(self, node, guard) -> None:
        self.put(node[1], self.value(node[2]), guard)

    def do_where(self, node, guard) -> None:
        self.df = self.df.where(truth(self.value(node[1])))

    def do_subset(self, node, guard) -> None:
        keep = truth(self.value(node[1]))
        self.df = self.df.where(keep if guard is None else keep | ~guard)

    def do_delete(self, node, guard) -> None:
        self.df = self.df.where(F.lit(False) if guard is None else ~guard)

    def do_if(self, node, guard) -> None:
        test = self.freeze(truth(self.value(node[1])))
        self.block(node[2], test if guard is None else guard & test)
        if node[3]:
            self.block(node[3], ~test if guard is None else guard & ~test)

    def do_loop(self, node, guard) -> None:
        """A DO loop with constant bounds, unrolled."""
        _, name, a, b, by, body = node
        bounds = [_constant(x) for x in (a, b, by)]
        if None in bounds or bounds[2] == 0 or (bounds[1] - bounds[0]) / bounds[2] > 200:
            raise StepError("a DO loop without constant bounds, or of more than 200 turns")
        v = bounds[0]
        while v <= bounds[1] if bounds[2] > 0 else v >= bounds[1]:
            self.put(name, (F.lit(v), "num"), guard)
            self.block(body, guard)
            v += bounds[2]
        self.put(name, (F.lit(v), "num"), guard)

    def do_keep(self, node, guard) -> None:
        self.keep += node[1]

    def do_drop(self, node, guard) -> None:
        self.dropped += node[1]

    def do_rename(self, node, guard) -> None:
        self.renames += node[1]

    def do_retain(self, node, guard) -> None:
        self.retained |= {n.lower(): v for n, v in node[1]}
        every = list(_walk(self.step.body))
        sums = {n[1].lower() for n in every if n[0] == "sum"}
        for name, start in node[1]:
            if name.lower() in sums or name.lower() in {c.lower() for c in self.df.columns}:
                continue
            value = F.lit(start[1]) if start and start[0] in ("num", "str") else None
            if any(n[0] == "assign" and n[1].lower() == name.lower() for n in every):
                self.carry(name, value)
            elif value is not None:
                self.df = self.df.withColumn(name, value)

    def carry(self, name: str, start: Column | None) -> None:
        """A retained field as each row finds it: what the last row before that assigned it left there, or its first value.

        What a row assigns must not depend on what it finds, and no row may end
        before it assigns; such a step would have to run row by row.
        """
        low, body = name.lower(), self.step.body
        at = max(k for k, n in enumerate(body) if any(m[0] == "assign" and m[1].lower() == low for m in _walk([n])))
        until = body[:at + 1]
        reads, grown = {low}, True
        while grown:  # fields that depend on what the row finds
            more = {m[1].lower() for m, under in _guarded(until) if m[0] in ("assign", "sum") and reads & _names([m[2], *under])} - {low}
            grown, reads = bool(more - reads), reads | more
        circular = any(m[0] == "assign" and m[1].lower() == low and reads & _names([m[2], *under]) for m, under in _guarded(until))
        if circular or any(m[0] in ("subset", "delete", "output", "loop") for m in _walk(until)):
            return self.do_problem(("problem", f"retain {name}", "the retained field needs the rows one after another"), None)
        sub = _Plan(self.step, self.tables, self.order_by, self.strict, [])
        sub.df, sub.retained = self.df.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in self.df.columns])), dict(self.retained)
        sub.df = sub.df.withColumn("__set", F.lit(0.0))
        sub.block([n for n in _marked(until, low) if n[0] != "retain"])
        self._order()
        if any(d for _, d in self.by):
            raise StepError("a retained field over descending keys")
        order = [_column(self.df, k) for k, _ in self.by] + [c for c in self.order_by if c.lower() not in {k.lower() for k, _ in self.by}]
        rows = sub.df.select("__row.*", F.col(_column(sub.df, name)).alias("__new"), (F.col("__set") == 1).alias("__has"))
        rows = carried(rows, F.col("__new"), F.col("__has"), order, "__found").drop("__has")
        kind = rows.schema["__new"].dataType
        first = start.cast(kind) if start is not None else F.lit(None).cast(kind)
        self.df = rows.drop("__new").withColumn(name, F.when(F.col("__found").isNull(), first).otherwise(F.col("__found.v"))).drop("__found")

    def do_sum(self, node, guard) -> None:
        """x + y: a running sum, from the last FIRST. reset on where there is one."""
        _, name, tree, _ = node
        x = num(self.value(tree))
        v = F.when(guard, x) if guard is not None else x
        start = self.retained.get(name.lower())
        base = float(start[1]) if start and start[0] == "num" else 0.0
        reset = self._reset_key(name)
        keys = [F.col(_column(self.df, k)).desc() if d else F.col(_column(self.df, k)) for k, d in self.by]
        if reset is not None:
            k, value = reset
            prefix = [_column(self.df, n) for n, _ in self.by[:k + 1]]
            w = W.partitionBy(*prefix).orderBy(*keys[k + 1:], *self._order()).rowsBetween(W.unboundedPreceding, 0)
            self.df = self.df.withColumn(name, F.sum(F.coalesce(v, F.lit(0.0))).over(w) + value)
        else:
            self._order()
            if any(d for _, d in self.by):
                raise StepError("a running sum over descending keys")
            order = [_column(self.df, k) for k, _ in self.by] + [c for c in self.order_by if c.lower() not in {k.lower() for k, _ in self.by}]
            self.df = running_sum(self.df, v, order, name).withColumn(name, F.col(name) + base)

    def _reset_key(self, name: str):
        """(place of the BY key, value) of `IF FIRST.key THEN name = value`, if the step has it."""
        for n in _walk(self.step.body):
            if n[0] == "if" and isinstance(n[1], tuple) and n[1][:2] == ("flag", "first"):
                for m in n[2]:
                    if m[0] == "assign" and m[1].lower() == name.lower() and (v := _constant(m[2])) is not None:
                        return [k.lower() for k, _ in self.by].index(n[1][2].lower()), v
        return None

    def do_output(self, node, guard) -> None:
        self.snapshots.append((self.df, guard if guard is not None else F.lit(True), [x.split(".")[-1].lower() for x in node[1]]))

    # --- the rows that go out ---

    def results(self) -> Tables:
        every = self.snapshots if self.explicit else [(self.df, F.lit(True), [])]
        out: Tables = {}
        for t in self.step.outputs:
            if t.name.lower() == "_null_":
                continue
            parts = [self.finish(df.where(g)) for df, g, only in every if not only or t.name.lower() in only]
            if parts:
                out[t.name] = _optioned(concatenate(parts), t.options, self.strict)
        return out

    def finish(self, df: DataFrame) -> DataFrame:
        low = {c.lower(): c for c in df.columns}
        names = [c for c in df.columns if not c.startswith("__") and c.lower() not in self.in_flags]
        if self.keep:
            wanted = {k.lower() for k in self.keep}
            names = [c for c in names if c.lower() in wanted]
        gone = {d.lower() for d in self.dropped}
        new = {a.lower(): b for a, b in self.renames}
        return df.select(*[F.col(f"`{low[c.lower()]}`").alias(new.get(c.lower(), c)) for c in names if c.lower() not in gone])


def _column(df: DataFrame, name: str) -> str:
    for c in df.columns:
        if c.lower() == name.lower():
            return c
    raise StepError(f"the column {name} is not there")


def _walk(body):
    for n in body:
        yield n
        if n[0] == "if":
            yield from _walk(n[2])
            yield from _walk(n[3])
        elif n[0] == "loop":
            yield from _walk(n[5])


def _guarded(body, under=()):
    """(statement, conditions it stands under) of a body."""
    for n in body:
        yield n, under
        if n[0] == "if":
            yield from _guarded(n[2], (*under, n[1]))
            yield from _guarded(n[3], (*under, n[1]))
        elif n[0] == "loop":
            yield from _guarded(n[5], under)


def _names(trees) -> set[str]:
    return {n.lower() for t in trees if t is not None for n, _ in E.references(t)}


def _marked(body, name: str) -> list:
    """The body with __set = 1 behind each assignment of a field."""
    out: list = []
    for n in body:
        if n[0] == "if":
            n = (n[0], n[1], _marked(n[2], name), _marked(n[3], name), *n[4:])
        out.append(n)
        if n[0] == "assign" and n[1].lower() == name:
            out.append(("assign", "__set", ("num", 1.0), "1"))
    return out


def _holds(body, kind: str) -> bool:
    return any(n[0] == kind for n in _walk(body))


def _constant(tree) -> float | None:
    if tree == ("missing",) or tree is None:
        return None
    if tree[0] == "num":
        return tree[1]
    if tree[0] == "un" and tree[1] == "-" and tree[2][0] == "num":
        return -tree[2][1]
    return None


def _inline(spark, columns: str, rows) -> DataFrame:
    """Inline data: blank-separated values; a $ after a name makes it text, a lone point is missing."""
    names = [w for w in columns.replace("$", " $ ").split() if w]
    fields = [(w, i + 1 < len(names) and names[i + 1] == "$") for i, w in enumerate(names) if w != "$"]
    data = []
    for r in rows:
        parts = r.split()
        data.append([None if i >= len(parts) or parts[i] == "." else parts[i] if is_text else float(parts[i]) for i, (_, is_text) in enumerate(fields)])
    schema = ", ".join(f"`{n}` {'string' if t else 'double'}" for n, t in fields)
    return spark.createDataFrame(data, schema)


# --- procedures ----------------------------------------------------------------


def _by_of(step: Step) -> list[tuple[str, bool]]:
    import re

    for t in step.text:
        if re.match(r"by\b", t, re.I):
            out, descending = [], False
            for w in re.findall(r"\w+", t)[1:]:
                if w.lower() == "descending":
                    descending = True
                else:
                    out.append((w, descending))
                    descending = False
            return out
    return []


def _words_after(step: Step, word: str) -> list[str]:
    import re

    return [w for t in step.text if re.match(rf"{word}\b", t, re.I) for w in re.findall(r"\w+", re.split(r"/", t)[0])[1:]]


def proc_sort(df: DataFrame, keys: list[tuple[str, bool]], nodupkey: bool = False) -> DataFrame:
    """Sorted rows; with nodupkey the first of each key, by all columns where they tie."""
    names = [_column(df, k) for k, _ in keys]
    order = [F.col(_column(df, k)).desc_nulls_last() if d else F.col(_column(df, k)).asc_nulls_first() for k, d in keys]
    if nodupkey:
        df = df.groupBy(*names).agg(F.min(F.struct(*[c for c in df.columns if c not in names])).alias("__x")).select(
            *[F.col(c) if c in names else F.col(f"__x.{c}").alias(c) for c in df.columns]
        )
    return df.orderBy(*order)


def proc_means(df: DataFrame, variables: list[str], classes: list[str] | None = None) -> DataFrame:
    """N, mean, standard deviation, minimum, maximum and sum of each variable, by class: a row per class and variable."""
    classes = classes or []
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(_column(df, v)).cast("double").alias("x")) for v in variables]))
    long = df.select(*classes, pairs.alias("p")).select(*classes, "p.variable", "p.x")
    return long.groupBy(*classes, "variable").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum("x").alias("sum")
    )


def proc_freq(df: DataFrame, variables: list[str]) -> DataFrame:
    """Counts and percentages of the combinations of values."""
    total = df.agg(F.count("*").alias("t"))
    return df.groupBy(*variables).agg(F.count("*").alias("count")).crossJoin(F.broadcast(total)).select(
        *variables, "count", (100.0 * F.col("count") / F.col("t")).alias("percent")
    )  # one row on the other side


def _procedure(step: Step, tables: Tables, last: DataFrame | None, spark) -> tuple[str | None, DataFrame | None]:
    import re

    df = _named(tables, step.inputs[0]) if step.inputs else last
    name = step.outputs[0].name if step.outputs else None
    if step.proc == "SORT":
        return name or (step.inputs[0].name if step.inputs else None), proc_sort(df, _by_of(step), bool(step.options.get("nodupkey")))
    if step.proc in ("MEANS", "SUMMARY"):
        return name, proc_means(df, _words_after(step, "var"), _words_after(step, "class") or _words_after(step, "by"))
    if step.proc == "FREQ":
        return name, proc_freq(df, [w for w in _words_after(step, "tables?")])
    if step.proc == "PRINT":
        return None, None
    if step.proc == "SQL":
        for k, v in tables.items():
            v.createOrReplaceTempView(k.split(".")[-1])
        result: tuple[str | None, DataFrame | None] = (None, None)
        for t in step.text[1:]:
            m = re.match(r"create\s+table\s+([\w.]+)\s+as\s+(.*)$", t, re.I | re.S)
            if m or re.match(r"select\b", t, re.I):
                result = (m[1].split(".")[-1] if m else None), spark.sql(m[2] if m else t)
                if m:
                    result[1].createOrReplaceTempView(result[0])
                    tables[result[0]] = result[1]
        return result
    raise StepError(f"PROC {step.proc} has no plan")


# --- running -------------------------------------------------------------------


def run_step(step: Step, tables: Tables, order_by: list[str] | None = None, strict: bool = False, problems: list | None = None, spark=None) -> Tables:
    """The tables that a DATA step writes."""
    plan = _Plan(step, tables, order_by, strict, problems if problems is not None else [])
    if spark is None:
        spark = next(iter(tables.values())).sparkSession
    plan.df = plan.source(spark)
    if not any(n[0] in ("set", "merge", "update", "datalines") for n in step.body):
        plan.df = spark.range(1).select()
    plan.block(step.body)
    return plan.results()


def run_program(code: str | Program, tables: Tables, order_by: list[str] | dict | None = None, strict: bool = False, expand_macros: bool = False, problems: list | None = None, spark=None) -> Tables:
    """All tables of a program, given those it reads: lazily planned, nothing runs here.

    `order_by` orders the rows of order-dependent steps: one list for all, or one for each output table.
    """
    program = code if isinstance(code, Program) else parse(code, expand_macros)
    have, made, last = dict(tables), {}, None
    if spark is None:
        spark = next(iter(tables.values())).sparkSession
    for step in program.steps:
        if step.kind == "data":
            order = order_by.get(step.output) if isinstance(order_by, dict) else order_by
            new = run_step(step, have, order, strict, problems, spark)
        else:
            name, df = _procedure(step, have, last, spark)
            new = {name: df} if name is not None and df is not None else {}
        for k, v in new.items():
            for old in [x for x in have if x.lower() == k.lower()]:
                del have[old]
            have[k] = v
            last = v
        made |= new
    return made


def evaluate(code: str | Program, table: str, df: DataFrame, output_fields: list[str] | None = None, problems: list | None = None) -> DataFrame:
    """The assignments of the step that writes `table`, on any rows: df with one column more, or replaced, for each.

    Only assignments outside conditions are evaluated; later ones see earlier ones.
    With `output_fields` only those, and what they need, are computed, and only those are added.
    An unknown table leaves df as it is.
    """
    program = code if isinstance(code, Program) else parse(code)
    step = next((s for s in program.data_steps if any(t.name.lower() == table.lower() for t in s.outputs)), None)
    if step is None:
        return df
    out, made = df, []
    wanted = {w.lower() for w in output_fields} if output_fields is not None else None
    needed = _needed(step, wanted) if wanted is not None else None
    for f in step.fields:
        if needed is not None and f.name.lower() not in needed:
            continue
        value = compile_expr(f.tree, Env.of(out.schema), False, problems) if f.tree is not None else (F.lit(None).cast("double"), "num")
        c = F.coalesce(value[0], F.lit(False)).cast("double") if value[1] == "bool" else value[0]
        low = {x.lower(): x for x in out.columns}
        out = out.withColumn(low.get(f.name.lower(), f.name), c)
        made.append(low.get(f.name.lower(), f.name))
    if wanted is not None:
        out = out.drop(*[c for c in made if c.lower() not in wanted and c not in df.columns])
    return out


def _needed(step: Step, wanted: set[str]) -> set[str]:
    """Fields of the step that the wanted ones are made of, themselves included."""
    need = set(wanted)
    for f in reversed(step.fields):
        if f.name.lower() in need:
            need |= {n.lower() for n, _ in f.deps}
    return need


