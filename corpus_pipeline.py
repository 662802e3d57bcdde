"""From raw documents to packed sequences: language ID, line dedup, near-duplicate removal, secrets, packing.

All stages but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.llm import language, linededup, minhash, packing, secrets
from loomery.llm.spill import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: what has no letters (so also a null text), and what two languages fit about equally. Without labelled rows no
    language is told, and all with letters stays."""
    said = language.identify(docs.select(*COLUMNS), F.lit(True), keep=tuple(COLUMNS))
    return said.where(F.col("text").rlike(r"\p{L}") & ~F.col("ambiguous")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of 50 words or more are deleted; documents that consisted of nothing else go."""
    rows = linededup.dedup_lines(docs.select(*COLUMNS))
    return _documents(rows.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 or more of their five-word shingles, directly or through others, the one with the least
    id stays; of rows with one id, that with the least hash of its text. Rows without an id stay."""
    groups = minhash.near_duplicates(docs)
    stays = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    rows = docs.select(*COLUMNS).join(stays, "doc_id", "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return rows.select(*COLUMNS).union(docs.select(*COLUMNS).where(F.col("doc_id").isNull()))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it give way to their kind in brackets."""
    return _documents(secrets.redact_secrets(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack_sequences)]
ORACLE_SQL = None  # n-gram classifiers, MinHash and a tokenizer are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs)
    return docs
