"""The opN queries: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, erasure, importance_resampling, jaccard_join, language_id, lexical_search, lm_scoring, mixing, pii, quality_rules, sharding, token_counts
from .common import crc_of_id, read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.pmod(crc_of_id(), F.lit(3)) == 1
    found = language_id.predict(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.pmod(crc_of_id(), F.lit(7)) == 2
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    return lm_scoring.fit_and_score(docs, docs.where(~F.col("held_out")), ("doc_id", "held_out"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(read(spark, sf_dir, "documents"), k=4, percent=85).drop("row_key")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(read(spark, sf_dir, "documents"), budgets=(token_counts.LIMIT,))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit", F.col("fits")[0].alias("words_in_limit"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("matches")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents")).drop("found")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op13_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erasure.erase(*[read(spark, sf_dir, t) for t in ("clients", "clicks", "sales", "sale_lines")])


def base_of_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact counts of op3's operator, learnt from documents that SQL can name."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = lm_scoring.fit_and_score(docs, docs.where("doc_id % 7 <> 2"))
    return found.select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_of_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op10's operator."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_of_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9's result: rows, sizes, shards, gapless slots, and texts in one shard only."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    placed = op9_sharding(spark, sf_dir)
    per = placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("size"), (F.max("slot") + 1).alias("slots"), F.count_distinct("slot").alias("distinct_slots"))
    split = placed.join(docs, "doc_id").groupBy("text").agg(F.count_distinct("shard").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("texts_in_several"))
    total = per.agg(F.count("*").alias("n_shards"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("slots").alias("slots"), F.sum("distinct_slots").alias("distinct_slots"))
    return total.join(F.broadcast(split))


#: Parts of operators' results that SQL can express, beside the operators' own queries.
BASES = (base_of_lm_scoring, base_of_quality_rules, base_of_sharding)

OPERATORS = (
    op1_language_id,
    op2_importance_resampling,
    op3_lm_scoring,
    op4_jaccard_join,
    op5_token_counts,
    op6_decontamination,
    op7_pii,
    op8_mixing,
    op9_sharding,
    op10_quality_rules,
    op11_lexical_search,
    op12_bpe,
    op13_erasure,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS + BASES}
