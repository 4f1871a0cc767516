"""Registered queries of the text operators: thin projections of each operator's own result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from skylane.llm import oracle
from skylane.llm.audit import filter_interactions
from skylane.llm.chunks import fingerprints_with_next
from skylane.llm.embeddings import embedding_components
from skylane.llm.html import extract_pages
from skylane.llm.language import identify
from skylane.llm.licenses import license_scan
from skylane.llm.mixing import mix_documents, word_count
from skylane.llm.pieces import encode_texts, load_vocabulary
from skylane.llm.quality import classify
from skylane.llm.secrets import secret_report
from skylane.llm.simhash import simhash_components
from skylane.llm.spelling import spelling_groups
from skylane.llm.tokens import document_token_counts


#: Where the public tokenizer files are.
TOKENIZERS = os.environ.get("SKYLANE_TOKENIZERS", "/opt/tokenizers")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_next(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", separator=50256)


#: Target weights of the mixing query; names without a weight have 1.
MIXTURE = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    mixed = mix_documents(docs, MIXTURE, total_share=1.0, max_epochs=3, seed=7)
    return mixed.select("doc_id", "epoch", "lang", "source", word_count(mixed["text"]).alias("n_tokens"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, load_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")).select("doc_id", "ids", "n_ids", "round_trip")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_counts": op5_token_counts,
    "op6_source_mixing": op6_source_mixing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_html_extraction": op8_html_extraction,
    "op9_license_scan": op9_license_scan,
    "op10_secret_scan": op10_secret_scan,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_language_id": op12_language_id,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}

#: The others are no SQL (hashes, chunking, learning, tokenizers, parsing, matches with their places): tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": oracle.EMBEDDINGS,
    "op6_source_mixing": oracle.mixing_sql(MIXTURE, 1.0, 3, 7),
    "op9_license_scan": oracle.LICENSES,
    "op13_filter_audit": oracle.FILTERS,
}
