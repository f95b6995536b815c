"""A corpus from raw documents to tokens: five stages, each stored before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, exact_dedup, mixing, ngram_join, store, toxicity
from ledgerloom.llm.queries import table, tokenizer

TOXIC_FROM = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model is trained on labelled rows of the input.

    Null and empty texts score like texts without toxic windows; each row is
    judged by itself, so repeated rows and null ids stay or go alike, and further columns go along."""
    store.purge(spark)
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), TOXIC_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: most code points, then the smallest id (null last); of a repeated row, one.

    Null and empty texts are one group.  Texts of any length, empty tables and further columns of any name will do."""
    store.purge(spark)
    digest, place, of, sha = (store.unused(c, docs.columns) for c in ("digest", "place", "of", "sha"))
    stay = exact_dedup.exact_dedup(docs, all_digests=True).where("kept").select(F.col("doc_id").alias(of), F.col("text_sha256").alias(sha)).distinct()
    hashed = docs.withColumn(digest, F.sha2(exact_dedup.normalised(F.col("text")), 256))
    kept = hashed.join(stay, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(digest) == F.col(sha)), "left_semi")
    first = Window.partitionBy("doc_id", digest).orderBy(F.desc(F.length("text")), "text")
    return kept.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that word 5-grams link at Jaccard 0.8 or more.

    Rows of one id are one document and stay or go together.  Rows without an
    id stay, as do texts without words, which link with nothing."""
    store.purge(spark)
    near = ngram_join.jaccard_components(docs).where("component_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(near, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at weights 1, 2, 3, repeating; a document as often as the mix takes it.

    Texts without words take no space in the mix and go; a null source is one
    of its own; rows with a null or shared id each have their own share."""
    store.purge(spark)
    return mixing.repeated(docs, mixing.mix(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, checked by decoding them; a row for each row."""
    store.purge(spark)
    return bpe.checked_frame(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix_sources), ("BPE", encode)]
#: SQL can't express a trained classifier or a tokenizer; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is that of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = store.fresh_path(spark, "stage-" + name.replace(" ", "-"), purged=False)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
