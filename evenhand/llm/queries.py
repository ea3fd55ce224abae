"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.common import crc_remainder, table
from evenhand.llm.decontam import contaminated, contamination
from evenhand.llm.html import extract
from evenhand.llm.licenses import license_spans
from evenhand.llm.line_dedup import drop_shared_lines
from evenhand.llm.lm import likelihoods
from evenhand.llm.ngram_join import similar_groups
from evenhand.llm.packing import pack
from evenhand.llm.pii import BASE, of_kind, personal_data, span_text
from evenhand.llm.prefix_trie import prefix_trie, turn_sequences, with_shared_heads
from evenhand.llm.quality import quality
from evenhand.llm.tokens import count_tokens, tokenizer_json
from evenhand.llm.toxicity import TOXIC, toxicity
from evenhand.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """Rules of the public tokenizer that packing and counting use."""
    import public_tokenizers

    return tokenizer_json(public_tokenizers.path("word_bpe_49k.json"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda span: span["base"] & (span["errors"] == 0))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(spans["label"])), ",")
    return found.withColumn("base_spans", base).select(
        "doc_id",
        "n_words",
        F.size("base_spans").cast("bigint").alias("n_base"),
        F.array_min("base_spans.first_word").alias("first_word"),
        F.array_max("base_spans.first_word").alias("last_word"),
        labels(F.col("base_spans")).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max("spans.fit"), F.lit(0.0)).alias("score"),
        "spans",
    )


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda span: span["kind"].isin([kind.name for kind in BASE]))
    return found.select(
        "row.doc_id",
        *[of_kind(spans, kind.name).alias(f"n_{kind.name}") for kind in BASE],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
        F.coalesce(F.array_max("spans.score"), F.lit(0.0)).alias("top_score"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        F.size("near").cast("bigint").alias("n_near"),
        F.array_join("near.item", ",").alias("near_items"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_lines",
        "n_bad_lines",
        "kept_chars",
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_remainder(F.col("doc_id"), 7) == 2
    found = likelihoods(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), *[c for c in found.columns if c != "doc_id"])


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), vocabulary())
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_remainder(F.col("doc_id"), 3) == 1
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    return toxicity(table(spark, sf_dir, "documents"), labels).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"),
        "offending",
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=32)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = with_shared_heads(turn_sequences(table(spark, sf_dir, "conversations")), block=100, most=6)
    return prefix_trie(rebuilt).drop("node")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_shared_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"), "most_docs")


QUERIES: dict[str, Query] = {
    "op1_licenses": op1_licenses,
    "op2_personal_data": op2_personal_data,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_lm_score": op5_lm_score,
    "op6_main_text": op6_main_text,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_join": op10_ngram_join,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_line_dedup": op13_line_dedup,
}
