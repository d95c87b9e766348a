"""Registered queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.llm import bpe, chat, divergence, exact_dedup, grammar, importance, jaccard_join, licenses, mixing, pii, quality, sql, suffix_dedup, url_rules


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def op1_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    tokens = bpe.encode_decode(documents, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    return mixing.mix(documents)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return exact_dedup.exact_dedup(documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_grammar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"))
    out = chat.format_records(chat.records_of_rows(rows.unionByName(planted)), "record", "conv_id")
    read = out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                      chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents", "lang", "source", "text"))


def op13_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents", "doc_id", "text"))
    kinds = F.transform("seeds", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, lambda kind: (kind == k).cast("int")), 0)).cast("long").alias(f"n_{name}")
              for k, name in enumerate(pii.NAMES)]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("seeds")), 256).alias("base_sha256"),
                        pii.spans_text(F.concat("seeds", "found")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repetition_rules": op1_repetition_rules,
    "op2_bpe_automaton": op2_bpe_automaton,
    "op3_license_scan": op3_license_scan,
    "op4_source_mixing": op4_source_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_grammar_files": op8_grammar_files,
    "op9_url_rules": op9_url_rules,
    "op10_chat_format": op10_chat_format,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_source_divergence": op12_source_divergence,
    "op13_contextual_pii": op13_contextual_pii,
}

ORACLE = dict(sql.ORACLE)
