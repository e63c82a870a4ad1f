"""Writers of reports and evaluated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_dot(graphs: DataFrame, path: str) -> None:
    """lineage.dot()'s texts, a directory for each program."""
    graphs.write.mode("overwrite").partitionBy("program_id").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
