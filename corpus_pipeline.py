"""A training corpus from ``documents``: good texts, one of each near-duplicate group, without
personal data, in an order that keeps sources at their target weights, as token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, pii, quality, simhash
from tidemark.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry ranking doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id."""
    return simhash.keep_one_per_group(docs).select(COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in place of personal data; ``n_chars`` counts the new text."""
    return pii.replace_pii(docs, pii.session_key(spark), entities=None).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the Pfair schedule."""
    return mixing.mixed_order(docs).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, digests of them and of what they decode to, and as
    ``mix_position`` the place of each document in the order the files of ``docs`` hold, which
    is the one that the mixing stage wrote."""
    path = public_tokenizers.path("word_bpe_49k.json")
    # the place travels with the id, as the encoder reads no other columns
    placed = mixing.place_in_files(docs.select("doc_id", "text")).select(F.struct("doc_id", "mix_position").alias("doc_id"), "text")
    encoded = bpe.encode_documents(placed, path, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    return encoded.select("doc_id.doc_id", *encoded.columns[1:], "doc_id.mix_position")


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", replace_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Learnt scores, 64-bit hashes and merges aren't expressible in SQL; tests/llm/test_pipeline.py
#: holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name))
    return STAGES[-1][1](spark, docs, sf_dir)
