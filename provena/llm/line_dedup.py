"""Line deduplication by an exact set-similarity join (operator 6).

A line is the set of its 5-word shingles (its whole word sequence, if shorter).
Tokens are ordered by rarity; prefix, length and positional filters leave the
candidates, and the Jaccard similarity of whole sets decides.  A line goes if an
earlier line, by document id and place, is equal or similar enough.

Most lines that have a match have the first line of some prefix token's list as a
match; only lines that don't are compared with the rest of their lists.

Lines without words are never removed.  Null and empty texts stay as they are, and a
text that loses no line is unchanged; a very long text is read in blocks of words.
Rows of equal id share one place in the order: a line of theirs goes if it stands in
a smaller id or under a smaller line number, and each row loses lines of its own text
only; repeated rows stay both.  Null ids come first.  An empty table gives an empty
one.  All columns of the table stay; those of the names of the counts are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.quality_rules import let
from provena.llm.setjoin import Join, candidates
from provena.llm.setjoin import lines as split_lines
from provena.llm.tables import by_key, cut, small, unused


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(i, k, lines): the documents that lose lines, a hash of the text, and the numbers of those lines."""
    join = Join(df, id_col, text_col, split_lines, n, percent, adaptive=False)
    lists = join.lists()
    gone = cut(join.linked(join.stars(lists)).select(F.col("a").alias("c")).distinct())
    left = lists.join(small(gone), "c", "left_anti")
    more = join.linked(candidates(left, lists, percent, F.col("y.place") < F.col("x.place"), ordered=True)).select(F.col("a").alias("c"))
    gone = cut(gone.union(more).distinct().withColumn("g", F.lit(True)))
    first = join.classes.select("c", "members", F.col("place").alias("first")).join(small(gone), "c", "left").where("g or members > 1")
    lost = by_key(join.rows.where("n > 0").select("i", "k", "line", "c", "place"), cut(first), "c", "members").where("g or place != first")
    return lost.groupBy("i", "k").agg(F.collect_set("line").alias("lines"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, counts: tuple = ("n_lines", "n_removed")) -> DataFrame:
    """df with the text's later matches removed, and the two counts added (columns of df of these names are replaced)."""
    lost = cut(removals(df, id_col, text_col, n, percent))
    many = lost.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    i, k, gone = (unused(df, x) for x in ("__i", "__k", "__lost"))
    lost = small(lost.select(F.col("i").alias(i), F.col("k").alias(k), F.col("lines").alias(gone)), extra=8 * many)
    joined = df.join(lost, F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(k)), "left")
    split = F.split(F.col(f"`{text_col}`"), "\n")
    kept = let(split, lambda parts: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)), lambda k: F.get(parts, k)), "\n"
    ))
    text = F.when(F.col(gone).isNull(), F.col(f"`{text_col}`")).otherwise(kept)
    n_lines = F.when(F.col(f"`{text_col}`").isNull(), F.lit(0)).otherwise(F.size(split)).cast("long")
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns if c not in counts]
    return joined.select(*columns, n_lines.alias(counts[0]), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(counts[1]))
