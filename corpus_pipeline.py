"""Corpus pipeline: language ID, exact dedup, near-duplicate removal, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of documents; the last returns a row per document of the mix with its token count and digests.
"""

from __future__ import annotations

from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import table, written
from tidemark.llm.byte_bpe import encoded, tokenizer_file
from tidemark.llm.exact_dedup import drop_copies
from tidemark.llm.language_id import UNKNOWN, identify
from tidemark.llm.mixing import Mix, mixed, words
from tidemark.llm.ngram_join import drop_linked
from tidemark.shipping import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null or have no letter go."""
    ship(spark)
    return identify(docs, names=("__lang", "__score")).where(F.col("__lang") != UNKNOWN).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the largest doc_id stays."""
    return drop_copies(docs, keep="max")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of 5-word shingle sets with a Jaccard similarity of 0.8 or more, one row stays: the smallest doc_id.

    Rows are decided one by one, also where a doc_id is null (larger than any number) or repeated.
    """
    ship(spark)
    return drop_linked(docs, n=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice."""
    return mixed(docs, Mix(max_epochs=2.0), words(), prefix="__mix_").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return encoded(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: SQL can express neither the parsing nor the byte-pair merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
