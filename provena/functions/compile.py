"""Expression trees to typed Columns.

Missing is null and sorts below every value: comparisons treat two missing values
as equal and a missing one as less.  Division by zero, bad conversions and unknown
functions give null (with strict=True the last raises), never an error of the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.functions.registry import REGISTRY, Typed, Unsupported, moment, num, text


class Env:
    """Names of fields, whatever their case, with their typed columns."""

    def __init__(self, columns: dict[str, Typed] | None = None):
        self.columns: dict[str, Typed] = {}
        for k, v in (columns or {}).items():
            self.columns[k.lower()] = v

    @classmethod
    def of(cls, schema: T.StructType) -> Env:
        return cls({f.name: (F.col(f"`{f.name}`"), kind_of(f.dataType)) for f in schema.fields})

    def get(self, name: str) -> Typed:
        return self.columns.get(name.lower(), (F.lit(None).cast("double"), "num"))

    def knows(self, name: str) -> bool:
        return name.lower() in self.columns


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "str"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return "datetime"
    return "num"


def truth(x: Typed) -> Column:
    """A condition's value: missing and 0 are false, an empty text too."""
    c, kind = x
    if kind == "str":
        return F.trim(text(x)) != ""
    if kind == "bool":
        return F.coalesce(c, F.lit(False))
    if kind in ("date", "datetime"):
        return c.isNotNull()
    return F.coalesce(c, F.lit(0.0)) != 0


def _plain(x: Typed) -> Typed:
    """A condition as a number, anything else as it is."""
    return (F.coalesce(x[0], F.lit(False)).cast("double"), "num") if x[1] == "bool" else x


def _compared(op: str, a: Typed, b: Typed) -> Typed:
    a, b = _plain(a), _plain(b)
    if "str" in (a[1], b[1]) and a[1] == b[1]:
        x, y = F.rtrim(text(a)), F.rtrim(text(b))  # trailing blanks do not count; an empty text is the missing one
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool"
    if "datetime" in (a[1], b[1]) and "num" not in (a[1], b[1]):
        x, y = moment(a), moment(b)
    elif a[1] == b[1] == "date":
        x, y = a[0], b[0]
    elif "date" in (a[1], b[1]) and "str" in (a[1], b[1]):
        x, y = (v[0].try_cast("date") for v in (a, b))
    else:
        x, y = num(a), num(b)
    same = x.eqNullSafe(y)
    less = F.coalesce(x < y, x.isNull() & y.isNotNull())
    return {"=": same, "!=": ~same, "<": less, "<=": less | same, ">": ~(less | same), ">=": ~less}[op], "bool"


def _dates(op: str, a: Typed, b: Typed) -> Typed | None:
    """Days moved or counted, where dates take part in a sum or difference."""
    if op == "-" and a[1] == b[1] == "date":
        return F.datediff(a[0], b[0]).cast("double"), "num"
    if op == "-" and "datetime" in (a[1], b[1]) and "num" not in (a[1], b[1]):
        if "date" in (a[1], b[1]):
            return F.datediff(F.to_date(a[0]), F.to_date(b[0])).cast("double"), "num"
        return F.unix_micros(moment(a)) / 1e6 - F.unix_micros(moment(b)) / 1e6, "num"
    if a[1] == "date" and b[1] == "num" and op in "+-":
        days = F.floor(b[0]).cast("int")
        return (F.date_add(a[0], days) if op == "+" else F.date_sub(a[0], days)), "date"
    return None


def compile_expr(node, env: Env, strict: bool = False, problems: list | None = None, flags=None) -> Typed:
    """The typed Column of a tree.  `flags(which, name)` gives FIRST. and LAST. conditions."""

    def go(x) -> Typed:
        kind = x[0]
        if kind == "num":
            return F.lit(float(x[1])), "num"
        if kind == "str":
            return F.lit(x[1]), "str", x[1]
        if kind == "missing":
            return F.lit(None).cast("double"), "num"
        if kind == "date":
            return _literal(x[1])
        if kind == "name":
            return env.get(x[1])
        if kind == "qual":
            return env.get(x[2])
        if kind == "flag":
            if flags is None:
                raise Unsupported("FIRST. or LAST. outside a BY group")
            return flags(x[1], x[2]), "bool"
        if kind == "if":
            c, a, b = truth(go(x[1])[:2]), _plain(go(x[2])[:2]), _plain(go(x[3])[:2])
            if "str" in (a[1], b[1]):
                return F.when(c, text(a)).otherwise(text(b)), "str"
            return F.when(c, a[0]).otherwise(b[0]), a[1]
        if kind == "in":
            tests = [_compared("=", go(x[1])[:2], go(y)[:2])[0] for y in x[2]]
            out = F.lit(False)
            for t in tests:
                out = out | t
            return out, "bool"
        if kind == "un":
            a = go(x[2])[:2]
            if x[1] == "not":
                return ~truth(a), "bool"
            return (-num(_plain(a)) if x[1] == "-" else num(_plain(a))), "num"
        if kind == "bin":
            return binary(x[1], x[2], x[3])
        if kind == "call":
            return call(x[1], x[2])
        raise Unsupported(f"{kind} in an expression")

    def binary(op: str, left, right) -> Typed:
        a, b = go(left)[:2], go(right)[:2]
        if op in ("and", "or"):
            return (truth(a) & truth(b) if op == "and" else truth(a) | truth(b)), "bool"
        if op in ("=", "!=", "<", "<=", ">", ">="):
            return _compared(op, a, b)
        a, b = _plain(a), _plain(b)
        if op == "||":
            return F.concat(text(a), text(b)), "str"
        if (d := _dates(op, a, b)) is not None:
            return d
        x, y = num(a), num(b)
        if op == "%":  # the sign follows the divisor
            return x - y * F.floor(F.try_divide(x, y)), "num"
        if op in ("max", "min"):
            return (F.greatest if op == "max" else F.least)(x, y), "num"
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "**": lambda: F.pow(x, y)}[op](), "num"

    def call(name: str, args) -> Typed:
        if name in ("put", "input"):
            return _formatted(name, _plain(go(args[0])[:2]), args[1][1] if len(args) > 1 else "")
        f = REGISTRY.get(name)
        if f is None:
            raise Unsupported(f"the function {name.upper()}")
        given = [_plain(v) if v[1] == "bool" else v for v in map(go, args)]
        try:
            return f(*given)
        except TypeError as e:
            raise Unsupported(f"{name.upper()} with {len(args)} arguments") from e

    try:
        return go(node)[:2]
    except (Unsupported, KeyError) as e:
        if strict:
            raise
        if problems is not None:
            problems.append(str(e))
        return F.lit(None).cast("double"), "num"


def _literal(said: str) -> Typed:
    if said.endswith("dt"):
        return F.try_to_timestamp(F.initcap(F.lit(said[:-2].lower())), F.lit("ddMMMyyyy:HH:mm:ss")), "datetime"
    return F.try_to_date(F.initcap(F.lit(said[:-1].lower())), "ddMMMyyyy"), "date"


#: Informats and the patterns they stand for.
_DATES = {"yymmdd": "yyyy-MM-dd", "mmddyy": "MM/dd/yyyy", "ddmmyy": "dd/MM/yyyy", "date": "ddMMMyyyy"}


def _formatted(name: str, x: Typed, fmt: str) -> Typed:
    base = fmt.rstrip("0123456789.").lstrip("$")
    width = "".join(ch for ch in fmt.split(".")[0] if ch.isdigit())
    if name == "input":
        if base == "datetime":
            return F.try_to_timestamp(F.initcap(F.lower(text(x))), F.lit("ddMMMyyyy:HH:mm:ss")), "datetime"
        if base in _DATES:
            return F.try_to_date(F.initcap(F.lower(F.trim(text(x)))) if base == "date" else F.trim(text(x)), _DATES[base]), "date"
        if fmt.startswith("$"):
            return text(x), "str"
        return F.translate(F.trim(text(x)), ",$", "").try_cast("double"), "num"
    if base == "z" and width:
        return F.lpad(num(x).cast("decimal(20,0)").cast("string"), int(width), "0"), "str"
    if base in _DATES and x[1] in ("date", "datetime"):
        return F.date_format(x[0], _DATES[base]), "str"
    decimals = fmt.split(".")[1] if "." in fmt else ""
    if x[1] == "num" and decimals.isdigit() and int(decimals):
        return F.format_string(f"%.{int(decimals)}f", num(x)), "str"
    if x[1] == "num" and fmt.rstrip(".").isdigit():
        return F.trim(F.round(num(x)).cast("decimal(20,0)").cast("string")), "str"
    return text(x), "str"
