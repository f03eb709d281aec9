"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, personal data and tokens, in this order."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsieve.llm import bpe, decontam, pii, rules, simhash
from proofsieve.session import remove, shared_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, with all their columns.

    Null, empty and short texts fail the base rules and go; a null language is one of its own; repeated rows are judged
    one by one; an empty table gives no rows.
    """
    return rules.reject(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id, with all its columns.

    Rows count each for itself, equal ones too; those without doc_id stay where a group has no others; texts without
    words are near-duplicates of each other; an empty table gives no rows.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of the benchmark, with all their columns.

    Null and empty texts stay, as do all without items; items that are null or have no letters are not searched for;
    repeated rows are searched one by one; an empty table gives no rows.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitising(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without personal data and what reveals it; other columns stay, n_chars follows the text.

    Null and empty texts stay as they are; repeated rows come out one by one; an empty table gives no rows.
    """
    return pii.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as rows (doc_id, ids, n_tokens, decoded_sha256): token ids, and a digest of what they decode to.

    Null and empty texts have no ids and decode to the empty text; repeated rows and null ids come out one by one; an
    empty table gives no rows.
    """
    lexicon = bpe.build_lexicon(docs, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.round_trip(docs, lexicon).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("sanitising", sanitising), ("tokens", tokens)]

#: SimHash links, edit distances and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's rows are removed when the
    next one's are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
