"""Queries of this subpackage: opN_<name> over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import oracle
from provena.llm.tables import table


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from provena.llm.bpe import encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(table(spark, sf_dir, "documents"), path, digests_only=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.quality_rules import quality_rules

    labels = table(spark, sf_dir, "labels")
    return quality_rules(table(spark, sf_dir, "documents"), labels.where(F.col("quality") == 1))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.chat import digests, format_chats

    odd = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("bigint").alias("turn"), F.lit("assistant").alias("role")))).alias("x")).select("conv_id", "x.turn", "x.role", F.lit(odd).alias("text"))
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_chats(chats))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm import toxicity
    from provena.llm.labelled import remainder

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), keep=remainder("doc_id", 5) != 0)
    return toxicity.score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm import pii

    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm import bloom_lm
    from provena.llm.labelled import remainder

    docs = table(spark, sf_dir, "documents")
    model = bloom_lm.fit(docs.where(remainder("doc_id", 5) != 1))
    return bloom_lm.score(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm import mil_quality
    from provena.llm.labelled import remainder

    docs = table(spark, sf_dir, "documents")
    model = mil_quality.fit(docs, table(spark, sf_dir, "labels"), keep=remainder("doc_id", 3) != 1)
    return mil_quality.score(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_passages")


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_toxicity, op3_pii, op4_bloom_lm, op5_byte_bpe, op6_line_dedup, op7_decontaminate, op8_quality_rules, op9_chat_format, op10_mil_quality,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_ngram_join": oracle.NGRAM_JOIN, "op6_line_dedup": oracle.LINE_DEDUP, "op9_chat_format": oracle.CHAT_FORMAT}
