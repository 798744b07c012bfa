"""The queries of this subpackage's operators and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import preferences, prefix_trie, rules, turn_repair, url_rules
from .minhash import near_duplicates
from .mixing import taken_words
from .passages import repeated_passages
from .pieces import encoded
from .prefix_trie import conversation_trie
from .quality_crf import quality
from .sstable import token_ids
from .toxicity import toxicity
from .turn_repair import repaired_conversations
from .winnowing import edited_likeness


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; another folder can be given as spark.folioloom.tokenizers."""
    import public_tokenizers

    spark = SparkSession.getActiveSession()
    folder = spark and spark.conf.get("spark.folioloom.tokenizers", None)
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.preferences(preferences.answered_otherwise(table(spark, sf_dir, "conversations")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_id_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judged(table(spark, sf_dir, "pages"))
    return judged.withColumn("mined", F.array_join("mined", " "))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_substring_dedup,
        op3_quality_classifier,
        op4_mixing,
        op5_sentencepiece,
        op6_chat_formatting,
        op7_toxicity,
        op8_quality_rules,
        op9_token_id_sstable,
        op10_fingerprints,
        op11_structure_repair,
        op12_prefix_trie,
        op13_url_filters,
    )
}

SQL: dict[str, str] = {
    "op6_chat_formatting": preferences.SQL,
    "op8_quality_rules": rules.SQL,
    "op11_structure_repair": turn_repair.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_url_filters": url_rules.SQL,
}
