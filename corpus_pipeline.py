"""Corpus preparation: quality, near-duplicates, secrets, mixture and token ids, each stage on all its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.
Null texts and ids, empty and very long texts, repeated rows, extra columns and empty tables have the results that the
operators' own docstrings define.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylane.llm.mixing import mix_documents
from skylane.llm.pieces import encode_texts, load_vocabulary
from skylane.llm.quality import quality_scores, train
from skylane.llm.secrets import redact_secrets
from skylane.llm.simhash import drop_near_duplicates
from skylane.llm.staging import discard, staged

#: Target weights by level and name; names without a weight have 1. The mixture takes this share of the tokens it is given.
MIXTURE = {"domain": {"d0": 4, "d1": 3, "d2": 3, "d3": 3}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
MIXTURE_SHARE = 0.95
PIECE_MODEL = os.environ.get("SKYLANE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from all labels, does not reject (score 0.3 or more)."""
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    marked = docs.select(F.struct("*").alias("doc"), F.col("text").alias("text"))
    return quality_scores(marked, weights).where("predicted = 1").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash groups, then all pairs of five-word shingle sets with similarity 0.8 or more."""
    return drop_near_duplicates(docs, shingle_words=5, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind; ``n_chars`` follows the text."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take: of each leaf a seeded prefix of one epoch."""
    return mix_documents(docs, MIXTURE, total_share=MIXTURE_SHARE, max_epochs=1).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document: ``doc_id, lang, source, ids, n_ids, round_trip``."""
    return encode_texts(docs, load_vocabulary(PIECE_MODEL)).select("doc_id", "lang", "source", "ids", "n_ids", "round_trip")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: A classifier and piece encoding are no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, staged(stage(spark, docs, sf_dir), name)
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
