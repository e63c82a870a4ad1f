"""The corpus pipeline: quality, line dedup, near-duplicate documents, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
all but the last return the columns of documents.  An empty table passes through every
stage as an empty one; null ids, null texts and repeated rows are kept or dropped by
what each stage says, and further columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import mil_quality
from provena.llm.bpe import encode
from provena.llm.decontaminate import decontaminate
from provena.llm.line_dedup import line_dedup
from provena.llm.ngram_join import ngram_join
from provena.llm.tables import by_key, cut, small, table, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows, doesn't reject; without labels of both kinds all share one score."""
    model = mil_quality.fit(docs, table(spark, sf_dir, "labels"))
    return mil_quality.keep(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; those that lose every word go, texts without words and null texts stay."""
    total, gone = unused(docs, "__n_lines"), unused(docs, "__n_removed")
    out = line_dedup(docs, counts=(total, gone)).where(~((F.col(gone) > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word shingles with Jaccard 0.8 the document of the smallest id, and those that are linked with none.

    Rows are told apart by id and text, so that rows of one id don't share a fate.  Null
    ids come last; of equal ids the lesser hash of the text stays; of rows equal in
    both one stays, unless they hold no word.
    """
    key, row, id_ = (unused(docs, x) for x in ("__k", "__row", "__id"))
    # 62 bits of id and text: a row's number, which says nothing of its order
    number = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    keyed = docs.select(number.alias(key), F.col("text"))
    found = cut(ngram_join(keyed, id_col=key, n=5, percent=80).where("n_shingles > 0"))
    ids = docs.select(number.alias(row), F.col("doc_id").alias(id_)).groupBy(row).agg(F.first(id_).alias(id_), F.count("*").alias("copies"))
    members = found.select(F.col(key).alias(row), F.col("component_id").alias("c")).distinct().join(ids, row)
    lost = cut(_losers(members, row, id_))
    gone = docs.join(small(lost.select(row)), number == F.col(row), "left_anti")
    twice = cut(members.where("copies > 1").select(row).join(lost, row, "left_anti"))
    if twice.isEmpty():
        return gone
    twice = small(twice.withColumnRenamed(row, key))
    once = gone.join(twice, number == F.col(key), "left_semi").dropDuplicates(["doc_id", "text"])
    return gone.join(twice, number == F.col(key), "left_anti").unionByName(once)


def _losers(members: DataFrame, row: str, id_: str) -> DataFrame:
    """The rows of components that are not their component's first."""
    lead = cut(members.groupBy("c").agg(F.min(id_).alias("low"), F.count("*").alias("m")).where("m > 1"))
    led = by_key(members, lead, "c", "m")
    best = cut(led.where(F.col(id_).eqNullSafe(F.col("low"))).groupBy("c").agg(F.min(row).alias("best"), F.min("m").alias("of")))
    return by_key(led, best, "c", "of").where(F.col(row) != F.col("best")).select(row)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and ends of every document, with the digests of ids and of the decoded text; a null text is an empty one."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("tokens", tokens)]

#: The classifier and the tokeniser can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
