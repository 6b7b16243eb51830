"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import (
    decontaminate,
    hilbert_ann,
    html_main,
    kneser_ney,
    langid,
    lexical,
    licenses,
    mixing,
    pii,
    preference,
    simhash_dedup,
    spelling,
    token_files,
)
from flowlens.llm.common import table


def op1_site_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_pages(table(spark, sf_dir, "pages"))


def op2_unigram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(table(spark, sf_dir, "documents"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_conversations(table(spark, sf_dir, "conversations"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bm25_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op8_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search_embeddings(table(spark, sf_dir, "embeddings"))


def op9_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_documents(table(spark, sf_dir, "documents"))


def op11_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_gram_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_document_words(table(spark, sf_dir, "documents"))


def op13_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_site_template_text, op2_unigram_langid, op3_preference_format, op4_mix_sources, op5_golay_simhash,
        op6_bm25_decontaminate, op7_license_scan, op8_hilbert_ann, op9_skip_chain_pii, op10_kneser_ney,
        op11_best_position_search, op12_gram_spelling_variants, op13_simple8b_token_files)
}

ORACLE_SQL: dict[str, str] = {
    "op3_preference_format": preference.ORACLE_SQL,
    "op4_mix_sources": mixing.ORACLE_SQL,
    "op11_best_position_search": lexical.ORACLE_SQL,
}
