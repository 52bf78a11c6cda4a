"""A training-data pipeline over ``documents``: quality rules, SimHash
near-duplicates, repeated substrings, secrets, packing.

Each stage takes what the one before it kept, written as Parquet and read
again. All but the last return the columns of ``documents``: rejected and
duplicate documents are gone, texts have lost repeated windows, secrets are
masked. The last returns the pieces of every document, with their token ids
and their places in the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vitalrates.llm import packing, quality, secret_scan, simhash, substring
from vitalrates.llm.common import settled, table

TOKENIZER = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, bits=3)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(docs, window=50)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_texts(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: near-duplicate components, tested cutoffs and packing have no SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, lambda: stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
