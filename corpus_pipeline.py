"""A corpus through five stages; each takes (spark, docs, sf_dir) and returns what it keeps, which is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.minhash import near_duplicates
from folioloom.llm.mixing import mixed
from folioloom.llm.passages import without_repeats
from folioloom.llm.pieces import encoded
from folioloom.llm.queries import table, tokenizer
from folioloom.llm.shared import small_batches, written
from folioloom.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compression distance does not call toxic."""
    with small_batches(spark):  # these hold when the stage runs, so it is written here
        return written(toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns), "not-toxic")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join, at 80 % of shingles of five words."""
    gone = near_duplicates(docs, words=5).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words stay only where they stand first."""
    return without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or pieces of them, as often as their source's target asks for."""
    return mixed(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row's whole text."""
    return encoded(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL has no words for compression, sketches or pieces; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
