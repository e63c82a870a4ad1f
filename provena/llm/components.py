"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.tables import cut


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") > F.col("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = e.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(low.select("u", F.col("m").alias("v"))).where(F.col("u") > F.col("v")).distinct()


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(c, comp) for every class in a pair (a, b): comp is the smallest class reachable."""
    e = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    state = None
    for _ in range(rounds):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now["n"] == 0 or now == state:
            break
        state = now
        e = cut(_small(_large(e)))
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    return e.select(F.col("u").alias("c"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("c"), F.col("v").alias("comp"))).distinct()
