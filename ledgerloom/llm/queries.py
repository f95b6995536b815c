"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import ann, bpe, exact_dedup, license_scan, mixing, ngram_join, substring_dedup, token_binary, toxicity, url_filter
from ledgerloom.llm.store import fresh_path


def tokenizer(name: str) -> str:
    """Where an installed public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (url_filter.number(F.col("url")) % 365).alias("fetch_day"))
    return url_filter.evaluate(captures, url_filter.drawn_changes(pages))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, 20)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.per_document(docs, license_scan.scan(docs))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), all_digests=True)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_binary.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"))
    return token_binary.read_tokens(spark, path, digest=True)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_toxicity, op3_ngram_jaccard, op4_ann, op5_substring_dedup, op6_license_scan, op7_exact_dedup, op8_bpe, op9_token_binary, op10_mixing)}
ORACLES = {"op1_url_filters": url_filter.ORACLE, "op6_license_scan": license_scan.oracle(), "op7_exact_dedup": exact_dedup.ORACLE, "op10_mixing": mixing.ORACLE}
