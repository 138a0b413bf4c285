"""The registered queries of the subpackage, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import toxicity, warc, wordpiece
from tidemark.llm.decontam import find_leaks
from tidemark.llm.language import held_out, identify, learn_profiles
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix_sources
from tidemark.llm.quality import quality_filter
from tidemark.llm.rlz import dedup_substrings
from tidemark.llm.suffixes import dedup_suffixes
from tidemark.llm.variants import group_variants
from tidemark.llm.whitening import whiten


def vocabulary() -> str:
    """The vocabulary that tokens are counted by; any sentence-piece model file will do."""
    if named := os.environ.get("TOKENIZER_MODEL"):
        return named
    import public_tokenizers  # only this query needs the package

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    pieces = wordpiece.read_pieces(vocabulary())
    return wordpiece.count_tokens(table(spark, sf, "documents").select("doc_id", "text"), pieces)


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    profiles = learn_profiles(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).drop("text")


def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(table(spark, sf, "documents"))


def op5_minmax_hash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"), k=3, percent=85)


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").where(~held_out())
    model = toxicity.learn(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return toxicity.score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)


def op7_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op8_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(spark, sf, "documents"), weights=[5, 2, 1], cap=3.0)


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_filter(table(spark, sf, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = dedup_suffixes(table(spark, sf, "documents"), span=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_warc(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    found = warc.look_up(warc.archive(pages, min_bytes=0), pages)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(table(spark, sf, "embeddings"), components=32, weigh=True)


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return group_variants(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_minmax_hash": op5_minmax_hash,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_mix_sources": op8_mix_sources,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_warc": op11_warc,
    "op12_whitening": op12_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}
