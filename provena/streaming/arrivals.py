"""Lineage of programs as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provena.operators.catalog import Catalog, parse_programs


def arriving(spark: SparkSession, folder: str, expand_macros: bool = False) -> DataFrame:
    """A stream of parsed programs, one row for each new file of the folder."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.sas").load(folder)
    named = files.select(F.input_file_name().alias("program_id"), F.input_file_name().alias("path"), F.col("value").alias("code"))
    return parse_programs(named, expand_macros)


def maintain(parsed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the edges and definitions of each micro-batch to tables under `out`.

    A batch that is written again after a failure replaces its own folder, so that nothing appears twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        cat = Catalog(batch)
        cat.edges.write.mode("overwrite").parquet(f"{out}/edges/batch={number}")
        cat.definitions.write.mode("overwrite").parquet(f"{out}/definitions/batch={number}")
        cat.programs.write.mode("overwrite").parquet(f"{out}/programs/batch={number}")
        cat.parsed.unpersist()

    return parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
