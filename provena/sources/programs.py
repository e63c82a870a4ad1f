"""Scans of program texts and of the tables that they are evaluated on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_programs(spark: SparkSession, *paths: str, glob: str = "*.sas") -> DataFrame:
    """(program_id, path, code) of every program file under the paths, each file once; a program's id is its path, for base names recur."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(list(paths))
    return files.dropDuplicates(["path"]).select(
        F.col("path").alias("program_id"), "path", F.decode("content", "UTF-8").alias("code")
    )


def programs(spark: SparkSession, codes: dict[str, str]) -> DataFrame:
    """(program_id, path, code) of program texts in hand."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("program_id", "path", "code")])
    return spark.createDataFrame([(k, None, v) for k, v in codes.items()], schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header; types are inferred where no schema is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """One sheet, read on the driver: a sheet holds about a million rows at most.  Needs a reader that pandas finds."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def one_row(spark: SparkSession, values: dict) -> DataFrame:
    """A single row from texts: whole numbers and decimals are read as such, anything else stays text."""

    def read(v):
        if not isinstance(v, str):
            return v
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return v

    from pyspark.sql import Row

    return spark.createDataFrame([Row(**{k: read(v) for k, v in values.items()})])
