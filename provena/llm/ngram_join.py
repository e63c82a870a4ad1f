"""N-gram Jaccard join with adaptive multi-match prefixes (operator 1).

Every document's prefix is lengthened by the l that the sketch's list lengths
make cheapest (read the lists of a longer prefix, verify fewer candidates); a
pair becomes a candidate only with as many shared prefix tokens as the smaller
of its two l.  Candidates are verified on whole sets.

Null and empty texts, and texts without words, have no shingle and are linked
with nothing: they are their own component.  Equal sets are one class and linked.
Rows of equal id keep a row each; null ids never lead a component unless alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.components import components
from provena.llm.setjoin import Join, candidates, whole
from provena.llm.tables import cut


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, adaptive: bool = True) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links)."""
    join = Join(df, id_col, text_col, whole, n, percent, adaptive)
    lists = join.lists()
    links = join.linked(join.stars(lists))
    comp = components(links)

    # What the stars leave apart: lists with more than one component; members outside a list's largest one meet all others.
    placed = lists.join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c")).drop("first")
    by = placed.groupBy("token", "comp").agg(F.count("*").alias("k"))
    main = by.groupBy("token").agg(F.max_by("comp", F.shiftleft("k", 32) + F.pmod(F.xxhash64("comp"), F.lit(1 << 32))).alias("main"), F.count("*").alias("m")).where("m > 1").select("token", "main")
    open_lists = cut(placed.join(main, "token"))
    strays = open_lists.where("comp != main")
    apart = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.c") < F.col("y.c")))
    more = join.linked(candidates(strays, open_lists, percent, apart))
    comp = components(links.union(more))

    named = join.classes.select("c", "low").join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    lows = named.groupBy("comp").agg(F.min("low").alias("component"))
    place = named.select("c", "comp").join(lows, "comp").select("c", "component")
    rows = join.rows.select("i", "n", "c")
    some = rows.where("n > 0").join(place, "c").select(F.col("i").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
    none = rows.where("n = 0").select(F.col("i").alias(id_col), F.lit(0).cast("long").alias("n_shingles"), F.col("i").alias("component_id"))
    return some.unionByName(none)
