"""The subpackage's registered queries, over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import hostrules, mixing, topk, urlfilter
from tarn.llm.bpe import encode_documents
from tarn.llm.common import table
from tarn.llm.licenses import scan_licences
from tarn.llm.minhash import near_duplicates
from tarn.llm.nbsvm import classify, fit
from tarn.llm.pii import sanitise
from tarn.llm.suffix import repeated_passages


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows, of all, of every embedding whose id is divisible by 100."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents kept, with their host's failures and shrunk rate."""
    return hostrules.judge(table(spark, sf_dir, "documents")).where("keep").select("doc_id", "host", "docs", "failed", "rate")


def op3_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, and whether they decode to its text."""
    return encode_documents(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's decision, over the links in the pages and redirects derived from their ids."""
    pages = table(spark, sf_dir, "pages")
    return urlfilter.decide(pages, redirects=urlfilter.derived_redirects(pages))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every near-duplicate document and the one kept in its stead."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice in the documents."""
    return scan_licences(table(spark, sf_dir, "documents"))


def op7_mixing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to temperature weights, as many tokens as there are."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "epoch", "n_tokens", "text")


def op8_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, sanitised."""
    return sanitise(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_mentions", "n_terms")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with both scores."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels"))).where("keep").select("doc_id", "quality_score", "toxic_score")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of 50 words or more."""
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_host_quality_rules": op2_host_quality_rules,
    "op3_bpe_encoding": op3_bpe_encoding,
    "op4_url_filter": op4_url_filter,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_mixing_to_weights": op7_mixing_to_weights,
    "op8_pii_sanitisation": op8_pii_sanitisation,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLES = {
    "op1_exact_top_k": topk.ORACLE_SQL,
    "op2_host_quality_rules": hostrules.ORACLE_SQL,
    "op4_url_filter": urlfilter.ORACLE_SQL,
    "op7_mixing_to_weights": mixing.ORACLE_SQL,
}
