"""Scalar functions of the language as Column builders.

Each builder gets typed arguments, pairs (Column, kind) with kind num, str, date
or datetime, and returns such a pair.  Missing values are null: arithmetic passes
them on, statistics over arguments leave them out, and nothing raises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Typed = tuple[Column, str]
REGISTRY: dict[str, Callable] = {}


class Unsupported(ValueError):
    """An expression that has no plan; the caller decides whether that is null or an error."""


def function(*names: str):
    def add(f: Callable) -> Callable:
        for n in names:
            REGISTRY[n] = f
        return f

    return add


def register(name: str, builder: Callable) -> None:
    """Add a function of the user's own: builder(*typed arguments) -> typed result."""
    REGISTRY[name.lower()] = builder


def num(x: Typed) -> Column:
    c, kind = x[0], x[1]
    if kind == "str":
        return c.try_cast("double")
    if kind == "date":
        return F.datediff(c, F.lit("1960-01-01").cast("date")).cast("double")
    return c.cast("double")


def text(x: Typed) -> Column:
    c, kind = x[0], x[1]
    if kind == "num":
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(c.isNull(), ".").when(whole, c.cast("decimal(20,0)").cast("string")).otherwise(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit(""))


def _least_or_greatest(f: Callable):
    def build(*args: Typed) -> Typed:
        cols = [num(a) for a in args]
        return (f(*cols) if len(cols) > 1 else cols[0]), "num"

    return build


REGISTRY["max"] = _least_or_greatest(F.greatest)
REGISTRY["min"] = _least_or_greatest(F.least)


@function("sum")
def _sum(*args: Typed) -> Typed:
    cols = [num(a) for a in args]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    return F.when(F.coalesce(*cols).isNotNull(), total), "num"


@function("n")
def _n(*args: Typed) -> Typed:
    return sum((num(a).isNotNull().cast("double") for a in args), F.lit(0.0)), "num"


@function("nmiss")
def _nmiss(*args: Typed) -> Typed:
    return sum((num(a).isNull().cast("double") for a in args), F.lit(0.0)), "num"


@function("mean", "avg")
def _mean(*args: Typed) -> Typed:
    return F.try_divide(_sum(*args)[0], _n(*args)[0]), "num"


@function("abs")
def _abs(x: Typed) -> Typed:
    return F.abs(num(x)), "num"


@function("int")
def _int(x: Typed) -> Typed:
    c = num(x)
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double"), "num"


@function("float")
def _float(x: Typed) -> Typed:
    return num(x), "num"


@function("round")
def _round(x: Typed, unit: Typed | None = None) -> Typed:
    """To the nearest multiple of the unit (1), halves away from zero."""
    c, u = num(x), F.lit(1.0) if unit is None else num(unit)
    scaled = F.try_divide(F.abs(c), u)
    return F.signum(c) * F.floor(scaled + 0.5 + 1e-12 * scaled) * u, "num"


@function("floor")
def _floor(x: Typed) -> Typed:
    return F.floor(num(x)).cast("double"), "num"


@function("ceil")
def _ceil(x: Typed) -> Typed:
    return F.ceil(num(x)).cast("double"), "num"


@function("mod")
def _mod(x: Typed, y: Typed) -> Typed:
    """The remainder with the sign of the dividend."""
    return F.try_mod(num(x), num(y)), "num"


@function("sqrt")
def _sqrt(x: Typed) -> Typed:
    c = num(x)
    return F.when(c >= 0, F.sqrt(c)), "num"


@function("exp")
def _exp(x: Typed) -> Typed:
    return F.exp(num(x)), "num"


@function("log")
def _log(x: Typed) -> Typed:
    c = num(x)
    return F.when(c > 0, F.log(c)), "num"


@function("sign")
def _sign(x: Typed) -> Typed:
    return F.signum(num(x)), "num"


@function("coalesce")
def _coalesce(*args: Typed) -> Typed:
    return F.coalesce(*[num(a) for a in args]), "num"


@function("coalescec")
def _coalescec(*args: Typed) -> Typed:
    return F.coalesce(*[F.nullif(F.rtrim(text(a)), F.lit("")) for a in args], F.lit("")), "str"


@function("missing")
def _missing(x: Typed) -> Typed:
    c = F.rtrim(text(x)) == "" if x[1] == "str" else x[0].isNull()
    return c.cast("double"), "num"


@function("ifn")
def _ifn(test: Typed, yes: Typed, no: Typed) -> Typed:
    return F.when(F.coalesce(num(test), F.lit(0.0)) != 0, num(yes)).otherwise(num(no)), "num"


@function("ifc")
def _ifc(test: Typed, yes: Typed, no: Typed) -> Typed:
    return F.when(F.coalesce(num(test), F.lit(0.0)) != 0, text(yes)).otherwise(text(no)), "str"


# --- texts --------------------------------------------------------------------


@function("trim", "trimn")
def _trim(x: Typed) -> Typed:
    return F.rtrim(text(x)), "str"


@function("strip")
def _strip(x: Typed) -> Typed:
    return F.trim(text(x)), "str"


@function("left")
def _left(x: Typed) -> Typed:
    return F.ltrim(text(x)), "str"


@function("upcase")
def _upcase(x: Typed) -> Typed:
    return F.upper(text(x)), "str"


@function("lowcase")
def _lowcase(x: Typed) -> Typed:
    return F.lower(text(x)), "str"


@function("propcase")
def _propcase(x: Typed) -> Typed:
    return F.initcap(text(x)), "str"


@function("reverse")
def _reverse(x: Typed) -> Typed:
    return F.reverse(text(x)), "str"


@function("substr", "substrn")
def _substr(x: Typed, start: Typed, length: Typed | None = None) -> Typed:
    a = num(start).cast("int")
    n = F.length(text(x)) if length is None else num(length).cast("int")
    return F.substring(text(x), a, n), "str"


@function("scan")
def _scan(x: Typed, n: Typed, delimiters: Typed | None = None) -> Typed:
    """The nth word, from the end for a negative n; empty if there is none."""
    import re

    marks = delimiters[2] if delimiters is not None and len(delimiters) > 2 else " .<(+&!$*);^-/,%|"
    parts = F.filter(F.split(text(x), "[" + re.escape(marks).replace("\\ ", " ") + "]+"), lambda p: p != "")
    k = num(n).cast("int")
    return F.coalesce(F.try_element_at(parts, F.when(k != 0, k)), F.lit("")), "str"


@function("find", "index")
def _find(x: Typed, y: Typed, *_: Typed) -> Typed:
    return F.position(text(y), text(x)).cast("double"), "num"


@function("compress")
def _compress(x: Typed, chars: Typed | None = None) -> Typed:
    return F.call_function("translate", text(x), F.lit(" ") if chars is None else text(chars), F.lit("")), "str"


@function("compbl")
def _compbl(x: Typed) -> Typed:
    return F.regexp_replace(text(x), " +", " "), "str"


@function("tranwrd")
def _tranwrd(x: Typed, old: Typed, new: Typed) -> Typed:
    return F.replace(text(x), text(old), text(new)), "str"


@function("translate")
def _translate(x: Typed, to: Typed, source: Typed) -> Typed:
    return F.call_function("translate", text(x), text(source), text(to)), "str"


@function("length")
def _length(x: Typed) -> Typed:
    return F.greatest(F.length(F.rtrim(text(x))), F.lit(1)).cast("double"), "num"


@function("lengthn")
def _lengthn(x: Typed) -> Typed:
    return F.length(F.rtrim(text(x))).cast("double"), "num"


@function("cat")
def _cat(*args: Typed) -> Typed:
    return F.concat(*[text(a) for a in args]), "str"


@function("cats")
def _cats(*args: Typed) -> Typed:
    return F.concat(*[F.trim(text(a)) for a in args]), "str"


@function("catx")
def _catx(sep: Typed, *args: Typed) -> Typed:
    parts = F.filter(F.array(*[F.trim(text(a)) for a in args]), lambda p: p != "")
    return F.array_join(parts, sep[2] if len(sep) > 2 else " "), "str"


@function("countw")
def _countw(x: Typed) -> Typed:
    return F.size(F.filter(F.split(text(x), r"\s+"), lambda p: p != "")).cast("double"), "num"


# --- dates --------------------------------------------------------------------


def date(x: Typed) -> Column:
    c, kind = x[0], x[1]
    if kind == "num":
        return F.date_add(F.lit("1960-01-01").cast("date"), F.floor(c).cast("int"))
    if kind == "str":
        return c.try_cast("date")
    return F.to_date(c)


def moment(x: Typed) -> Column:
    return x[0].try_cast("timestamp") if x[1] == "str" else x[0].cast("timestamp")


def _part(f: Callable):
    return lambda x: (f(date(x)).cast("double"), "num")


for _name, _f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("qtr", F.quarter), ("weekday", F.dayofweek), ("week", F.weekofyear)):
    REGISTRY[_name] = _part(_f)
for _name, _f in (("hour", F.hour), ("minute", F.minute), ("second", F.second)):
    REGISTRY[_name] = lambda x, f=_f: (f(moment(x)).cast("double"), "num")


@function("datepart")
def _datepart(x: Typed) -> Typed:
    return F.to_date(moment(x)), "date"


@function("today", "date")
def _today() -> Typed:
    return F.current_date(), "date"


@function("mdy")
def _mdy(m: Typed, d: Typed, y: Typed) -> Typed:
    return F.try_to_date(F.concat_ws("-", *[num(v).cast("int").cast("string") for v in (y, m, d)]), "y-M-d"), "date"


def _months(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


@function("intck")
def _intck(unit: Typed, a: Typed, b: Typed) -> Typed:
    """Boundaries of the unit between two dates."""
    x, y = date(a), date(b)
    n = {
        "day": F.datediff(y, x), "dtday": F.datediff(y, x), "week": F.floor((F.datediff(y, F.lit("1960-01-03").cast("date"))) / 7) - F.floor((F.datediff(x, F.lit("1960-01-03").cast("date"))) / 7),
        "month": _months(y) - _months(x), "qtr": F.year(y) * 4 + F.quarter(y) - F.year(x) * 4 - F.quarter(x), "year": F.year(y) - F.year(x),
    }.get(str(unit[2]).lower() if len(unit) > 2 else "")
    if n is None:
        raise Unsupported("INTCK with this interval")
    return n.cast("double"), "num"


@function("intnx")
def _intnx(unit: Typed, start: Typed, n: Typed, align: Typed | None = None) -> Typed:
    """A date moved by intervals, to their beginning (default), end or the same day."""
    d, k = date(start), num(n).cast("int")
    u = str(unit[2]).lower() if len(unit) > 2 else ""
    where = str(align[2]).lower()[:1] if align is not None and len(align) > 2 else "b"
    months = {"month": 1, "qtr": 3, "year": 12}.get(u)
    if u == "day":
        return F.date_add(d, k), "date"
    if months is None:
        raise Unsupported("INTNX with this interval")
    if where == "s":
        return F.add_months(d, k * months), "date"
    begin = F.to_date(F.trunc(d, {"month": "month", "qtr": "quarter", "year": "year"}[u]))
    begin = F.add_months(begin, k * months)
    return (F.date_sub(F.add_months(begin, F.lit(months)), 1) if where == "e" else begin), "date"
