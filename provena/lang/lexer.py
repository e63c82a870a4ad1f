"""Statements and tokens of SAS programs.

One scanner knows quotes, both comment forms and inline data, so that neither a
semicolon in a string nor one in a comment ends a statement.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Words that are never fields.
KEYWORDS = frozenset(
    "data set merge by if then else do end where and or not in proc run quit output retain keep drop rename".split()
    + "eq ne gt lt ge le while until to delete stop length format label array".split()
)

_TOKEN = re.compile(
    r"""\s+
    |(?P<str>'(?:[^']|'')*'|"(?:[^"]|"")*")(?P<suffix>dt|d|t|n|x)?
    |(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<qual>(?:first|last)\.[A-Za-z_]\w*)
    |(?P<name>[A-Za-z_]\w*)
    |(?P<op>\*\*|\|\||<=|>=|\^=|~=|!=|<>|><|=|<|>|\+|-|\*|/|\(|\)|\[|\]|,|\.|&|\||\^|~|\$|:|\#|@|%|\?|\{|\})
    |(?P<other>.)""",
    re.X | re.I | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str  # str, num, name, qual (FIRST.x, LAST.x), op, date
    text: str
    at: int


@dataclass(frozen=True)
class Statement:
    text: str
    line: int
    data: tuple = ()  # the rows of inline data that follow


def tokens(text: str) -> list[Token]:
    out = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "suffix":
            kind = "str" if m["suffix"].lower() in "nx" else "date"
        if kind is None:
            continue
        value = m[0] if kind != "str" and kind != "date" else _plain(m["str"])
        out.append(Token(kind, value if kind != "date" else f"{value}{m['suffix'].lower()}", m.start()))
    return out


def _plain(quoted: str) -> str:
    q = quoted[0]
    return quoted[1:-1].replace(q + q, q)


def statements(code: str) -> list[Statement]:
    """The statements of a program with the line on which each begins."""
    out: list[Statement] = []
    i, n, line = 0, len(code), 1
    buf: list[str] = []
    begun = 0
    while i < n:
        c = code[i]
        if code.startswith("/*", i):
            j = code.find("*/", i + 2)
            j = n if j < 0 else j + 2
            line += code.count("\n", i, j)
            buf.append(" ")
            i = j
        elif c in "*%" and not begun and (c == "*" or code.startswith("%*", i)):  # a comment statement
            j = code.find(";", i)
            j = n if j < 0 else j + 1
            line += code.count("\n", i, j)
            i = j
        elif c in "'\"":
            j = i + 1
            while j < n and (code[j] != c or code[j + 1:j + 2] == c):
                j += 2 if code[j] == c else 1
            j = min(j + 1, n)
            begun = begun or line
            buf.append(code[i:j])
            line += code.count("\n", i, j)
            i = j
        elif c == ";":
            text = _joined(buf)
            if text:
                st = Statement(text, begun or line)
                if re.fullmatch(r"(datalines|cards|lines)4?", text, re.I):
                    mark = ";;;;" if text.endswith("4") else ";"
                    j = code.find(mark, i + 1)
                    j = n if j < 0 else j
                    rows = code[i + 1:j].split("\n")
                    rows = rows[1:] if rows and not rows[0].strip() else rows
                    st = Statement(text, begun or line, tuple(r for r in rows if r.strip()))
                    line += code.count("\n", i, j)
                    i = min(j + len(mark) - 1, n - 1)
                out.append(st)
            buf, begun = [], 0
            i += 1
        else:
            if c == "\n":
                line += 1
            if not c.isspace():
                begun = begun or line
            buf.append(c)
            i += 1
    if _joined(buf):
        out.append(Statement(_joined(buf), begun or line))
    return out


def _joined(buf: list[str]) -> str:
    """Pieces of a statement on one line: line ends and what is around them become one blank."""
    return re.sub(r"[ \t]*\r?\n\s*", " ", "".join(buf)).strip()


def normalize_whitespace(code: str) -> str:
    return re.sub(r"[ \t]+", " ", code)
