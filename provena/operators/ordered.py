"""Order-dependent operators over a whole table, without bringing it into one task.

Rows are range-partitioned by the order; each partition works by itself and then
takes an offset from the totals of the partitions before it (a table with a row
per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.operators.graph import cut

PART, AT = "__part", "__at"


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df cut into ranges of the order, with __part (rising with it) and __at (row number in the part)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()))
    return parts.withColumn(AT, F.row_number().over(W.partitionBy(PART).orderBy(*order)))


def _before(totals: DataFrame, value: str) -> DataFrame:
    """For each part the sum of `value` over the parts before it: one row a part."""
    w = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(totals.withColumn("__before", F.coalesce(F.sum(value).over(w), F.lit(0))).select(PART, "__before"))


def numbered(df: DataFrame, order: list[str], name: str = "__ord") -> DataFrame:
    """df with its row numbers (from 1) in a total order."""
    parts = ranged(df, order)
    before = _before(parts.groupBy(PART).agg(F.count("*").alias("n")), "n")
    return parts.join(before, PART).withColumn(name, F.col(AT) + F.col("__before")).drop(PART, AT, "__before")


def running_sum(df: DataFrame, value: Column, order: list[str], name: str) -> DataFrame:
    """df with the sum of `value` from the first row on, in a total order; missing values add nothing."""
    parts = ranged(df.withColumn("__v", F.coalesce(value.cast("double"), F.lit(0.0))), order)
    own = F.sum("__v").over(W.partitionBy(PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    before = _before(parts.groupBy(PART).agg(F.sum("__v").alias("n")), "n")
    return parts.join(before, PART).withColumn(name, own + F.col("__before")).drop(PART, AT, "__before", "__v")


def carried(df: DataFrame, value: Column, present: Column, order: list[str], name: str) -> DataFrame:
    """df with a struct<v> of the last `value` of an earlier row where `present` holds, in a total order; null where there is none."""
    parts = ranged(df.withColumn("__v", F.when(present, F.struct(value.alias("v")))), order)
    own = F.last("__v", ignorenulls=True).over(W.partitionBy(PART).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    ends = parts.groupBy(PART).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(AT))).alias("e"))  # a row a part
    w = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    before = F.broadcast(ends.select(PART, F.last("e", ignorenulls=True).over(w).alias("__before")))
    return parts.withColumn("__own", own).join(before, PART).withColumn(name, F.coalesce("__own", "__before")).drop(PART, AT, "__before", "__own", "__v")


def lagged(df: DataFrame, column: str, n: int, order: list[str], name: str) -> DataFrame:
    """df with the value of `column` n rows before, in a total order.

    Rows lag inside their range; the first n rows of a range, and they alone, look
    among the last n of the ranges before it, by row number.
    """
    parts = ranged(df.withColumn("__x", F.col(f"`{column}`")), order)
    sizes = parts.groupBy(PART).agg(F.count("*").alias("n"))
    parts = parts.join(_before(sizes, "n"), PART).join(F.broadcast(sizes.withColumnRenamed("n", "__size")), PART)
    own = F.lag("__x", n).over(W.partitionBy(PART).orderBy(*order))
    number = F.col("__before") + F.col(AT)
    tails = parts.where(F.col(AT) > F.col("__size") - n).select((number + n).alias("__g"), F.col("__x").alias("__lag"))
    first = parts.where(F.col(AT) <= n).withColumn("__g", number).join(tails, "__g", "left").drop("__g")
    rest = parts.withColumn("__lag", own).where(F.col(AT) > n)
    return rest.unionByName(first).drop(name, PART, AT, "__x", "__before", "__size").withColumnRenamed("__lag", name)
