"""The corpus pipeline: from raw documents to the mix that a model is trained on.

Each stage reads what the one before has kept, as Parquet. All but the last return the
columns of ``documents``; extra columns of the input are passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontam import find_leaks
from tidemark.llm.language import UNKNOWN, identify, learn_profiles
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix_sources
from tidemark.llm.scratch import Scratch
from tidemark.llm.suffixes import dedup_suffixes

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document is rejected if its nearest language is further than this share of the
#: largest distance: it is in none of the languages learned.
LEAST_SCORE = 0.15
NEAR_SHINGLE, NEAR_PERCENT = 5, 80
SPAN = 50
WEIGHTS, CAP = [5, 2, 1], 3.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus. Texts without letters, and those far from every
    profile, go; lang is what the text is in."""
    columns = docs.columns
    # The predictions' names must not meet columns of the input.
    inner = docs.withColumnsRenamed({c: f"_in_{i}" for i, c in enumerate(columns)})
    at = {c: f"_in_{i}" for i, c in enumerate(columns)}
    profiles = learn_profiles(inner, lang=at["lang"], text=at["text"])
    found = identify(inner, profiles, text=at["text"])
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col("lang_pred" if c == "lang" else at[c]).alias(c) for c in columns))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id. Rows that
    repeat an id and its text are one document; different texts under one id are documents of
    their own, after all others. Rows without an id stay."""
    own = F.col("doc_id")
    texts = docs.where(own.isNotNull()).select(own, F.xxhash64("text").alias("_t")).distinct()
    shared = texts.groupBy("doc_id").count().where("count > 1").select(own.alias("_shared"))
    keyed = docs.withColumn("_key", own.cast("bigint"))
    if not shared.isEmpty():
        # Positive, and larger than any id that a table numbers its rows by.
        made = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        keyed = docs.join(shared, own == F.col("_shared"), "left")
        keyed = keyed.withColumn("_key", F.when(F.col("_shared").isNotNull(), made).otherwise(own.cast("bigint"))).drop("_shared")
    found = near_duplicates(keyed.select("_key", "text"), k=NEAR_SHINGLE, percent=NEAR_PERCENT, doc_id="_key")
    gone = found.where(F.col("doc_id").isNotNull() & ~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    left = keyed.join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    kept = left.where(own.isNotNull()).dropDuplicates(["_key"]).unionByName(left.where(own.isNull()))
    return kept.select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier documents have; those left empty go. A
    character cut in two goes as a whole."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = dedup_suffixes(docs, span=SPAN, carry=rest)
    now = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    # A document that was empty before has lost nothing; one that lost all its words goes.
    stays = (F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S")
    kinds = dict(docs.dtypes)
    return found.where(stays).select(*(now[c].cast(kinds[c]).alias(c) if c in now else F.col(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, copied or paraphrased. Rows are told apart by a
    64-bit hash of id and text, so that rows without an id, or with the same one, count."""
    key = F.xxhash64("doc_id", "text")
    leaks = find_leaks(docs.select(key.alias("_key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="_key")
    return docs.join(leaks.select(F.col("doc_id").alias("_leak")).distinct(), key == F.col("_leak"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document the mix holds."""
    return mix_sources(docs, weights=WEIGHTS, cap=CAP)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: SQL cannot state the stages: hashing into bands, latent vectors, suffix order. The tests
#: hold run() against a plain version of each instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    work = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"{i}_{name}")
        if i:
            work.drop(f"{i - 1}_{STAGES[i - 1][0]}")
    return docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
