"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaboard.llm.audit import repair_damaged
from deltaboard.llm.containment import contained_items
from deltaboard.llm.language import held_out, predict_language, word_counts
from deltaboard.llm.maintext import extract_pages
from deltaboard.llm.neighbours import nearest_rows
from deltaboard.llm.phrases import collocations
from deltaboard.llm.pieces import encode_samples
from deltaboard.llm.quality import quality_rules
from deltaboard.llm.repeats import remove_repeats
from deltaboard.llm.secrets import scan_secrets
from deltaboard.llm.sharding import balanced_shards
from deltaboard.llm.simhash import near_copies
from deltaboard.llm.tables import table
from deltaboard.llm.token_files import token_round_trip
from deltaboard.session import Staging


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, Staging(spark))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = Staging(spark)(word_counts(docs), "words")
    return predict_language(docs, counts).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = balanced_shards(table(spark, sf_dir, "documents"), Staging(spark), shards=24)
    return put.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), Staging(spark)).drop("mark")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_samples(table(spark, sf_dir, "documents"), path)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), Staging(spark)).drop("clean_text")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), Staging(spark)).drop("kept", "spans")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), Staging(spark))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rows(table(spark, sf_dir, "embeddings"), Staging(spark), top=20, every=20)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"), Staging(spark))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), Staging(spark))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_token_files, op2_language, op3_decontamination, op4_sharding, op5_secrets, op6_sentencepiece,
        op7_quality_rules, op8_suffix_array, op9_simhash, op10_html, op11_neighbours, op12_conversations,
        op13_phrases,
    ]
    return {f.__name__: f for f in named}
