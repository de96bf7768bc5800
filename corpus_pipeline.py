"""From raw documents to packed training sequences: language, near copies, personal data, mixture, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.llm import langid, mixing, overlap, packing, pii, simhash
from loadcast.llm.common import remove, shared_folder, table
from loadcast.llm.queries import TOKENIZER, pii_key


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no text in any learned language: null texts and texts without a letter."""
    return langid.keep_known(docs, langid.train(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash, or by 0.8 of their five-word shingles, the one with the smallest id stays."""
    return overlap.deduplicate(docs, found=simhash.near_duplicates(docs))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and mail addresses become pseudonyms; ``n_chars`` follows the text."""
    changed = pii.pseudonymise(docs, pii_key(spark))
    return changed.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, in training order."""
    return mixing.in_order(mixing.curriculum(docs)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of the documents lie in training sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN))


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_near_copies),
    ("PII pseudonyms", pseudonyms),
    ("source mixture", mixture),
    ("best-fit packing", packed),
]
#: SQL can express neither the language model nor the genetic algorithm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between stages the rows lie as Parquet in the shared folder. Each stage's table is removed
    once the next one is written; the last one stays, as the result reads it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{n}")
            docs = spark.read.parquet(f"{folder}/{n}")
            if n:
                remove(spark, f"{folder}/{n - 1}")
    return docs
