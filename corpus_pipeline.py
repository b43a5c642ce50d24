"""Prepares a corpus for training in five stages, each the operator of that name on what the stage before it kept.

quality rules -> line dedup -> MinHash near-dedup -> benchmark decontamination -> byte-level BPE. Each stage takes
(spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from factloom.llm import bpe, decontam, line_dedup, near_dedup, quality
from factloom.llm.common import read_table, release, shared_folder
from factloom.llm.queries import RANKS
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps. Null and empty texts have too few words and go; an empty table stays empty."""
    return quality.judge(quality.ledger(docs)).where("kept").select(docs.columns)


def recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without recurring lines. n_chars, where there is one, is the new text's length. Null texts stay null."""
    made = line_dedup.drop_recurring_lines(docs)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8), the one with the least id.

    Documents without words are in no group and stay. Repeated rows of one id and text are all the least: one of them stays.
    """
    return near_dedup.near_duplicates(docs, merge_rows=True).where("kept").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, nor nearly occurs. With an empty benchmark all stay."""
    found = decontam.find_matches(docs, read_table(spark, sf_dir, "benchmark"))
    return found.where((F.size("hits") == 0) & (F.size("near_items") == 0)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, n_tokens, token_ids (packed little-endian unsigned 32-bit) and whether decoding gives the text back."""
    made = bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return made.select(*docs.columns, "n_tokens", "token_ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", recurring_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("byte_bpe", tokens),
]

#: SQL can't express the templates' hashes, signatures or merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage for the table documents; each stage is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark)
    return docs
