"""Programs: text to steps, statements, assigned fields and their references."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from provena.lang import expr as E
from provena.lang.lexer import Statement, statements, tokens
from provena.lang.macro import expand_reported


@dataclass
class Table:
    """A table named in DATA, SET or MERGE, with its options."""

    name: str
    lib: str | None = None
    options: dict = field(default_factory=dict)


@dataclass
class FieldDef:
    name: str
    table: str
    expression: str | None
    line: int
    stmt: int
    deps: list  # (name, table or None): what the value is made of
    controls: list = field(default_factory=list)  # fields of the conditions around it
    tree: tuple | None = None
    problem: str | None = None
    operation: str = "assignment"


@dataclass
class Step:
    kind: str  # data or proc
    line: int
    proc: str | None = None
    outputs: list = field(default_factory=list)
    inputs: list = field(default_factory=list)
    keys: list = field(default_factory=list)
    fields: list = field(default_factory=list)
    body: list = field(default_factory=list)  # statement nodes of DATA steps
    where: str | None = None
    options: dict = field(default_factory=dict)
    text: list = field(default_factory=list)  # statements of PROC steps

    @property
    def output(self) -> str | None:
        return next((t.name for t in self.outputs if t.name.lower() != "_null_"), None)


@dataclass
class Program:
    steps: list
    code: str
    fallback: str | None = None  # why the macros were left as they stand

    @property
    def data_steps(self) -> list:
        return [s for s in self.steps if s.kind == "data"]

    @property
    def proc_steps(self) -> list:
        return [s for s in self.steps if s.kind == "proc"]


def parse(code: str, expand_macros: bool = False, include_base=None) -> Program:
    """The steps of a program; with expand_macros (or include_base) its macros are expanded first."""
    fallback = None
    if expand_macros or include_base is not None:
        code, fallback = expand_reported(code, include_base)
    sts = statements(code)
    steps, i = [], 0
    while i < len(sts):
        word = _first(sts[i].text)
        if word == "data" and re.match(r"data\s+[A-Za-z_]", sts[i].text, re.I):
            i = _data_step(sts, i, steps)
        elif word == "proc" and re.match(r"proc\s+\w", sts[i].text, re.I):
            i = _proc_step(sts, i, steps)
        else:
            i += 1
    return Program(steps, code, fallback)


def _first(text: str) -> str:
    m = re.match(r"[A-Za-z_]\w*", text)
    return m[0].lower() if m else ""


def _ends(text: str) -> bool:
    return bool(re.fullmatch(r"(run|quit)(\s+\w+)?", text, re.I))


def table_list(text: str) -> list[Table]:
    """Names with options in parentheses: `lib.a (in=x keep=p q rename=(r=s)) b end=eof`."""
    toks, out, i = tokens(text), [], 0
    while i < len(toks):
        t = toks[i]
        if t.kind == "name":
            if i + 1 < len(toks) and toks[i + 1].text == "=":  # an option of the statement: end=eof
                i += 3
                continue
            name, lib = t.text, None
            if i + 2 < len(toks) and toks[i + 1].text == "." and toks[i + 2].kind == "name":
                lib, name = t.text, toks[i + 2].text
                i += 2
            out.append(Table(name, lib))
            i += 1
        elif t.text == "(" and out:
            depth, j = 1, i + 1
            while j < len(toks) and depth:
                depth += {"(": 1, ")": -1}.get(toks[j].text, 0)
                j += 1
            inner = text[t.at + 1:toks[j - 1].at] if not depth else text[t.at + 1:]
            out[-1].options = table_options(inner)
            i = j
        else:
            i += 1
    return out


def table_options(text: str) -> dict:
    """in, keep, drop, rename, where and others of a table's parentheses."""
    parts = re.split(r"\b(in|keep|drop|rename|where|obs|firstobs|end|label|compress)\s*=", text, flags=re.I)
    out: dict = {}
    for k, v in zip(parts[1::2], parts[2::2]):
        k, v = k.lower(), v.strip()
        if k in ("keep", "drop"):
            out[k] = re.findall(r"\w+", v)
        elif k == "rename":
            out[k] = re.findall(r"(\w+)\s*=\s*(\w+)", v)
        elif k == "where":
            out[k] = v[1:-1] if v.startswith("(") and v.endswith(")") else v
        else:
            out[k] = v
    return out


def _short(t: Table) -> str:
    """Tables go by the library's name where one is given, as the lineage catalogue keys them."""
    return t.lib or t.name


class _Body:
    """Statements of a DATA step as a tree, and the fields that they assign."""

    def __init__(self, step: Step):
        self.step, self.count = step, 0

    def block(self, sts: list[Statement], i: int, controls: list, inside: bool) -> tuple[list, int]:
        out = []
        while i < len(sts):
            text = sts[i].text
            if inside and re.fullmatch(r"end", text, re.I):
                return out, i + 1
            if not inside and (_ends(text) or _first(text) in ("data", "proc") and re.match(r"(data|proc)\s+\w", text, re.I) and not re.match(r"data\s*=", text, re.I)):
                return out, i
            node, i = self.statement(sts, i, controls)
            out += node
        return out, i

    def statement(self, sts: list[Statement], i: int, controls: list, text: str | None = None) -> tuple[list, int]:
        st = sts[i]
        text = st.text if text is None else text
        word = _first(text)
        rest = text[len(word):].strip()
        step = self.step
        if word == "if" and not re.match(r"=", rest):
            return self.condition(sts, i, controls, rest)
        if word == "do":
            return self.loop(sts, i, controls, rest)
        if word == "else":
            return [("problem", text, "ELSE without IF")], i + 1
        if word == "select" and (not rest or rest.startswith("(")):
            return self.select(sts, i, controls, rest)
        simple = {"set": "set", "merge": "merge", "update": "update"}
        if word in simple and rest and not rest.startswith("="):
            tables = table_list(rest)
            step.inputs += [t for t in tables]
            return [(simple[word], tables)], i + 1
        if word == "by" and rest and not rest.startswith("="):
            keys, descending = [], False
            for k in re.findall(r"\w+", rest):
                if k.lower() == "descending":
                    descending = True
                elif k.lower() != "notsorted":
                    keys.append((k, descending))
                    descending = False
            step.keys += [k for k, _ in keys]
            return [("by", keys)], i + 1
        if word == "where" and rest and not rest.startswith("="):
            step.where = rest
            return [("where", self._tree(rest), rest)], i + 1
        if word in ("keep", "drop") and rest and not rest.startswith("="):
            return [(word, re.findall(r"\w+", rest))], i + 1
        if word == "rename" and re.match(r"\w+\s*=", rest):
            return [("rename", re.findall(r"(\w+)\s*=\s*(\w+)", rest))], i + 1
        if word == "retain":
            return [("retain", self._retained(rest))], i + 1
        if word in ("output", "delete", "stop", "return") and not rest.startswith("="):
            return [(word, re.findall(r"[\w.]+", rest))], i + 1
        if re.fullmatch(r"(datalines|cards|lines)4?", text, re.I):
            return [("datalines", st.data)], i + 1
        if word == "input" and rest and not rest.startswith("="):
            return [("input", rest)], i + 1
        if word in ("length", "format", "informat", "label", "attrib", "array", "put", "infile", "file", "call") and rest and not rest.startswith("="):
            return [("ignored", text)], i + 1
        m = re.match(r"([A-Za-z_]\w*)\s*(\[[^\]]*\]|\{[^}]*\})?\s*=(?!=)\s*(.+)$", text, re.S)
        if m:
            return [self.assign(m[1], m[3].strip(), st.line, controls)], i + 1
        m = re.match(r"([A-Za-z_]\w*)\s*\+\s*(.+)$", text, re.S)
        if m:
            return [self.assign(m[1], m[2].strip(), st.line, controls, total=True)], i + 1
        return [("ignored", text)], i + 1

    def _tree(self, text: str):
        try:
            return E.parse(text)
        except E.SyntaxProblem:
            return None

    @staticmethod
    def _retained(rest: str) -> list:
        out: list = []
        sign = 1.0
        for t in tokens(rest):
            if t.kind == "name":
                out.append([t.text, None])
            elif t.text in "+-":
                sign = -1.0 if t.text == "-" else 1.0
            elif out:
                out[-1][1] = ("num", sign * float(t.text)) if t.kind == "num" else ("str", t.text) if t.kind == "str" else ("missing",)
                sign = 1.0
        if out and all(v is None for _, v in out[:-1]) and out[-1][1] is not None:  # RETAIN a b 0 gives both
            out = [[n, out[-1][1]] for n, _ in out]
        return [tuple(x) for x in out]

    def assign(self, name: str, text: str, line: int, controls: list, total: bool = False):
        problem = None
        try:
            tree = E.parse(text)
        except E.SyntaxProblem as e:
            tree, problem = None, str(e)
        first = self.step.inputs[0] if self.step.inputs else None
        table = _short(first) if first else None
        found = E.references(tree) if tree is not None else []
        deps = [(n, t or table) for n, t in found]
        under = [(n, t or table) for c in controls for n, t in E.references(c) if (n, t or table) not in deps]
        expression = f"{name} + {text}" if total else text
        out = self.step.output or "_null_"
        for o in [x for x in self.step.outputs if x.name.lower() != "_null_"][:1]:
            out = _short(o)
        self.step.fields.append(FieldDef(name, out, expression, line, self.count, deps, list(dict.fromkeys(under)), tree, problem, "calculation" if total else "assignment"))
        self.count += 1
        return ("sum" if total else "assign", name, tree, text)

    def condition(self, sts, i: int, controls: list, rest: str):
        m = _split_then(rest)
        if m is None:
            return [("subset", self._tree(rest), rest)], i + 1
        test, action = m
        tree = self._tree(test)
        under = [*controls, tree] if tree is not None else controls
        yes, i = self.branch(sts, i, under, action)
        no: list = []
        if i < len(sts) and _first(sts[i].text) == "else":
            no, i = self.branch(sts, i, under, sts[i].text[4:].strip())
        return [("if", tree, yes, no, test)], i

    def select(self, sts, i: int, controls: list, rest: str):
        """SELECT, with WHEN and OTHERWISE to its END, as IF and ELSE: the first WHEN that holds acts."""
        arms, under, j = [], controls, i + 1
        while j < len(sts) and not re.fullmatch(r"end", sts[j].text, re.I) and not _ends(sts[j].text):
            text = sts[j].text
            m = re.match(r"(when|otherwise)\b\s*", text, re.I)
            if m is None:
                return [("problem", text, "a statement between WHENs")], j + 1
            if m[1].lower() == "when":
                inner, action = _parenthesised(text[m.end():])
                test = " or ".join(f"({rest[1:-1]}) = ({v})" for v in _commas(inner)) if rest else inner
                tree = self._tree(test)
                under = [*under, tree] if tree is not None else under
            else:
                test, tree, action = "otherwise", ("num", 1.0), text[m.end():]
            body, j = self.branch(sts, j, under, action.strip())
            arms.append((test, tree, body))
        out: list = []
        for test, tree, body in reversed(arms):
            out = body if test == "otherwise" else [("if", tree, body, out, test)]
        return out, j + 1

    def branch(self, sts, i: int, controls: list, action: str):
        if re.fullmatch(r"do", action, re.I):
            return self.block(sts, i + 1, controls, True)
        if not action:
            return [], i + 1
        return self.statement(sts, i, controls, action)

    def loop(self, sts, i: int, controls: list, rest: str):
        body, j = self.block(sts, i + 1, controls, True)
        m = re.match(r"(\w+)\s*=\s*(.+?)\s+to\s+(.+?)(?:\s+by\s+(.+))?$", rest, re.I | re.S)
        if not rest:
            return body, j
        if m:
            return [("loop", m[1], self._tree(m[2]), self._tree(m[3]), self._tree(m[4]) if m[4] else ("num", 1.0), body)], j
        return [("problem", f"do {rest}", "DO loop")], j


def _parenthesised(text: str) -> tuple[str, str]:
    """(what stands in the first parentheses, what follows them)."""
    depth = 0
    for t in tokens(text):
        depth += {"(": 1, ")": -1}.get(t.text, 0) if t.kind != "str" else 0
        if not depth:
            return text[text.index("(") + 1:t.at], text[t.at + 1:]
    return text.strip("("), ""


def _commas(text: str) -> list[str]:
    """Parts at commas outside parentheses and quotes."""
    out, depth, last = [], 0, 0
    for t in tokens(text):
        if t.kind != "str":
            depth += {"(": 1, ")": -1}.get(t.text, 0)
            if t.text == "," and not depth:
                out.append(text[last:t.at])
                last = t.at + 1
    return [x.strip() for x in [*out, text[last:]]]


def _split_then(text: str) -> tuple[str, str] | None:
    for t in tokens(text):
        if t.kind == "name" and t.text.lower() == "then":
            return text[:t.at].strip(), text[t.at + 4:].strip()
    return None


def _data_step(sts: list[Statement], i: int, steps: list) -> int:
    st = sts[i]
    step = Step("data", st.line, outputs=table_list(st.text[4:]))
    body = _Body(step)
    step.body, j = body.block(sts, i + 1, [], False)
    steps.append(step)
    return j + 1 if j < len(sts) and _ends(sts[j].text) else j


def _proc_step(sts: list[Statement], i: int, steps: list) -> int:
    st = sts[i]
    name = re.match(r"proc\s+(\w+)", st.text, re.I)[1].upper()
    step = Step("proc", st.line, proc=name)
    j = i
    while j < len(sts):
        text = sts[j].text
        if j > i and (_ends(text) or re.match(r"(data|proc)\s+\w", text, re.I)):
            break
        step.text.append(text)
        for option, found in re.findall(r"\b(data|out)\s*=\s*([\w.]+)", text, re.I):
            parts = found.split(".")
            t = Table(parts[-1], parts[0] if len(parts) > 1 else None)
            if option.lower() == "data" and not step.inputs:
                step.inputs.append(t)
            elif option.lower() == "out" and not step.outputs:
                step.outputs.append(t)
        if _first(text) == "by":
            step.keys += [k for k in re.findall(r"\w+", text)[1:] if k.lower() not in ("descending", "notsorted")]
        j += 1
    step.options = {k.lower(): v for k, v in re.findall(r"(\w+)\s*=\s*([\w.]+)", st.text)}
    step.options |= {w.lower(): True for w in re.findall(r"\w+", st.text)[2:] if w.lower() in ("nodupkey", "nodup", "noduprecs", "noprint", "nway")}
    steps.append(step)
    return j + 1 if j < len(sts) and _ends(sts[j].text) else j
