"""Command line: python -m provena.cli PROGRAM [-q FIELD [-t TABLE] | -b [-t TABLE] | -g FILE] [-o FILE] [--text]."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from provena.operators import lineage
from provena.operators.catalog import Catalog
from provena.sources.programs import programs


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="provena")
    p.add_argument("program")
    p.add_argument("-q", "--query", help="a field to look up")
    p.add_argument("-t", "--table", help="only this table")
    p.add_argument("-b", "--browse", action="store_true")
    p.add_argument("-g", "--graph", help="write the graph to this file")
    p.add_argument("-o", "--output", help="write the result to this file as JSON")
    p.add_argument("--text", action="store_true", help="print lines for people instead of JSON")
    p.add_argument("--expand-macros", action="store_true")
    p.add_argument("--include-base")
    a = p.parse_args(args)
    path = Path(a.program)
    if not path.is_file():
        print(f"{a.program}: no such file", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("provena").getOrCreate()
    cat = Catalog.of(programs(spark, {path.stem: path.read_text()}), a.expand_macros or a.include_base is not None, a.include_base)
    if a.query:
        rows = lineage.query_field(cat, a.query, a.table)
    elif a.browse:
        rows = lineage.browse_fields(cat, a.table)
    elif a.graph:
        Path(a.graph).write_text(lineage.dot(cat).first()["dot"])
        return 0
    else:
        rows = lineage.stats(cat)
    found = [json.loads(x) for x in rows.toJSON().collect()]  # about one program
    if a.output:
        Path(a.output).write_text(json.dumps(found, indent=2))
    elif a.text:
        print("\n".join(_lines(found)))
    else:
        print(json.dumps(found, indent=2))
    return 0


def _lines(found: list, indent: str = "") -> list[str]:
    """Rows as indented lines, a blank one between them; lists and rows inside go below their name."""
    out: list[str] = []
    for k, row in enumerate(found):
        out += [""] * (k > 0 and not indent)
        for name, v in row.items() if isinstance(row, dict) else [("-", row)]:
            if isinstance(v, list) and any(isinstance(x, dict) for x in v):
                out += [f"{indent}{name}:", *_lines(v, indent + "  ")]
            else:
                out.append(f"{indent}{name}: {', '.join(map(str, v)) if isinstance(v, list) else v}")
    return out or [f"{indent}nothing found"]


if __name__ == "__main__":
    sys.exit(main())
