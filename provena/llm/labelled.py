"""A bounded sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, m: int) -> Column:
    """crc32(id as text) mod m."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(m))


def lowest(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The `rows` rows of the lowest hashes of their ids.  A hash bound that leaves a few times as many goes before the sort."""
    n = df.count()
    if n > 16 * rows:
        df = df.where(F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * 4 * rows / n))
    return df.orderBy(F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(1 << 30)), id_col).limit(rows)


def sample(df: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """(id, text, y) of at most `rows` labelled documents, those of the lowest hashes; null labels and ids are left out.

    `rows` bounds what is fitted, not what is scored.  The chosen labels are a few
    thousand rows, so that the documents are read in place and not shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    if keep is not None:
        known = known.where(keep)
    known = known.select(F.col(id_col).alias("__i"), F.col(label).cast("int").alias("y")).groupBy("__i").agg(F.max("y").alias("y"))
    few = lowest(known, "__i", rows)
    return df.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__t")).join(F.broadcast(few), "__i").select(
        F.col("__i").alias(id_col), F.col("__t").alias(text_col), "y"
    )
