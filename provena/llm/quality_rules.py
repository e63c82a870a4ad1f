"""Quality rules with a hashed n-gram log-likelihood ratio (operator 8), in DataFrame functions only.

Every document first passes fixed rules (enough words, not too much repetition).
One that does is kept if the mean log ratio of its hashed unigrams and bigrams
under two multinomials, trusted target against raw corpus, reaches a threshold.
The multinomials are counted over all documents (the target over all those
labelled 1); the threshold follows from the target's own scores, so that the
decision is a fixed comparison for every document and nothing is drawn at random.

Null and empty texts have no words and fail the base rules; repeated rows are
judged each; without trusted documents the ratio is 0 and the base rules decide; an
empty table gives an empty one.  A null id is nobody's and never trusted.  Texts are
read whole, one row at a time; only the id and the text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.tables import small

#: Word separators and symbols.
SEPARATORS = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def windows(h: Column) -> Column:
    """Hashes of the 3-word windows of an array of word hashes."""
    every = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    return F.when(F.size(h) < 3, F.array().cast("array<bigint>")).otherwise(F.slice(every, 1, F.size(h) - 2))


def repeat_words(g: Column) -> Column:
    """Words inside windows that occur twice or more, from the window hashes."""
    pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        at = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(at, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
            F.lit(0).cast("bigint"), lambda a, x: a + x,
        )

    return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(let(pairs, twice))


def base_rules(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The counts and the base verdict, with the word hashes still there."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    first = df.select(
        F.col(id_col).alias(id_col), word_hashes(F.col(text_col)).alias("__h"),
        F.length(F.translate(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    )
    out = first.select(
        id_col, "__h", F.size("__h").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        let(windows(F.col("__h")), repeat_words).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def bucket(x: Column, n_buckets: int) -> Column:
    return x.bitwiseAND(F.lit(n_buckets - 1)).cast("int")


def bigram(h: Column, x: Column, i: Column) -> Column:
    """A word's hash with the next one's, or with nothing at the end."""
    return F.shiftleft(x, 1).bitwiseXOR(F.coalesce(F.get(h, i + 1), F.lit(1).cast("bigint")))


def buckets(h: Column, n_buckets: int) -> tuple[Column, Column]:
    """Bucket numbers of the unigrams and bigrams of an array of word hashes."""
    return F.transform(h, lambda x: bucket(x, n_buckets)), F.transform(h, lambda x, i: bucket(bigram(h, x, i), n_buckets))


def ratios(df: DataFrame, trusted: DataFrame, id_col: str, text_col: str, n_buckets: int, smoothing: float) -> list[float]:
    """log(target / raw) of each bucket; a table of n_buckets numbers, whatever the corpus."""
    one, two = buckets(F.col("__h"), n_buckets)
    known = trusted.withColumns({"__i": F.col(id_col), "__t": F.lit(1)}).drop(id_col)
    marked = df.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__x")).join(known, "__i", "left").select("__t", word_hashes(F.col("__x")).alias("__h"))
    grams = marked.select(F.coalesce("__t", F.lit(0)).alias("__t"), F.explode(F.concat(one, two)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("__t").alias("target")).collect()  # n_buckets rows at most
    raw, target = [smoothing] * n_buckets, [smoothing] * n_buckets
    for r in counts:
        raw[r["b"]] += r["raw"]
        target[r["b"]] += r["target"]
    both = math.log(sum(raw)) - math.log(sum(target))
    if sum(target) <= 1.5 * smoothing * n_buckets and not any(r["target"] for r in counts):
        return [0.0] * n_buckets
    return [math.log(t) - math.log(r) + both for r, t in zip(raw, target)]


def mean_ratio(h: Column, table: list[float], n_buckets: int) -> Column:
    """Mean log ratio of the unigrams and bigrams of the words; 0 without words."""
    lookup = F.split(F.lit(" ".join(f"{x:.5f}" for x in table)), " ").cast("array<double>")  # folded to one constant
    each = F.transform(h, lambda x, i: F.get(lookup, bucket(x, n_buckets)) + F.get(lookup, bucket(bigram(h, x, i), n_buckets)))
    return F.when(F.size(h) == 0, F.lit(0.0)).otherwise(F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / (2 * F.size(h)))


def quality_rules(
    df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    n_buckets: int = 1 << 14, smoothing: float = 1.0, deviations: float = 4.0,
) -> DataFrame:
    """One row per document: id, the counts of the base rules, base_failed, log_ratio, kept.

    `trusted` holds the ids of the target's documents.  Those whose crc32(id) mod 5
    is not 0 are counted as target; the others, which the multinomials have not
    fitted, set the threshold: their mean ratio less `deviations` standard
    deviations (those of 50 words or more; where there are none, the counted ones).
    """
    ids = trusted.select(F.col(id_col).alias(id_col)).distinct()
    aside = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0
    n_trusted = ids.count()  # ids are broadcast while they are few megabytes; beyond that the texts are shuffled, not their words
    table = ratios(df, small(ids.where(~aside), n_trusted), id_col, text_col, n_buckets, smoothing)
    of_target = df.select(id_col, text_col).join(small(ids, n_trusted), id_col, "left_semi").select(aside.alias("aside"), word_hashes(F.col(text_col)).alias("__h")).where(F.size("__h") >= 50)
    spread = (
        of_target.select("aside", mean_ratio(F.col("__h"), table, n_buckets).alias("r")).groupBy("aside")
        .agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    )
    r = spread.where("aside").first() or spread.where("not aside").first()
    least = r["m"] - deviations * r["s"] if r else 0.0
    scored = base_rules(df, id_col, text_col).withColumn("log_ratio", mean_ratio(F.col("__h"), table, n_buckets))
    return scored.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio",
        (~F.col("base_failed") & (F.col("log_ratio") >= least)).alias("kept"),
    )
