"""Column helpers for field names and expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provena.lang.lexer import KEYWORDS


def normalize_field_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def split_reference(c: Column) -> Column:
    """struct(table, field) of `table.field` or `field`."""
    return F.struct(F.when(F.contains(c, F.lit(".")), F.substring_index(c, ".", 1)).alias("table"), F.regexp_replace(c, r"^[^.]*\.", "").alias("field"))


def called_functions(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\w+)\s*\("), F.lit(1))


def is_keyword(c: Column) -> Column:
    return F.lower(c).isin(*sorted(KEYWORDS))


def field_path(table: Column, field: Column) -> Column:
    return F.concat_ws(".", table, field)
