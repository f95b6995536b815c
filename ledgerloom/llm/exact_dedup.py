"""Exact deduplication by progressive refinement, in DataFrame functions only.

Rows are first grouped by the length of their normalised text, then by a hash
of its first characters, and only rows still sharing both are compared by the
full digest.  What moves between executors is one small fact row per document
(never a text), counts are combined before each shuffle, and the joins are
between fact rows and one row per surviving group, so a group of copies that
holds a third of the table is split by Spark's skew handling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import stored

BLANKS = " \t\n\v\f\r"
PREFIX_CHARS = 128


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null is empty."""
    return reduce(lambda c, b: F.replace(c, F.lit(b), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """One row per input row: id, code points, normalised length, prefix hash and full digest.

    With ``digest=False`` the last is null and the full content is hashed later, for survivors only."""
    norm = normalised(F.col("t"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).select(
        "doc_id",
        F.char_length(F.coalesce("t", F.lit(""))).cast("long").alias("n_points"),
        norm.alias("norm"),
    ).select(
        "doc_id",
        "n_points",
        F.octet_length("norm").cast("long").alias("norm_bytes"),
        F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix_hash"),
        (F.sha2("norm", 256) if digest else F.lit(None).cast("string")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_digests: bool = False) -> DataFrame:
    """Group rows whose normalised texts are equal and choose the row of each group that stays.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.
    The row with the most code points in its original text stays, then the
    smallest id (null ids come last); ids are of any type that has an order.
    The refinement decides which rows are compared: with ``all_digests`` every
    row's digest is asked for, so it is taken in the first scan, and only the
    grouping is spared.  ``text_sha256`` is null for rows that the
    refinement settled before their content was needed, unless ``all_digests``.

    Null text counts as empty; empty texts form one group; a repeated row (same
    id and text) counts each time, and every copy of the staying row is kept
    only once: of rows equal in id and text, all carry ``kept``, since nothing
    tells them apart.  Empty input gives an empty result.  Other columns are
    ignored, whatever their names.
    """
    rows = stored(facts(docs, id_col, text_col, digest=all_digests), "exact_facts")
    shapes = rows.groupBy("norm_bytes", "prefix_hash").agg(F.count("*").alias("n"))  # combined where the rows lie: a group of copies is one row
    by_length = shapes.groupBy("norm_bytes").agg(F.sum("n").alias("total")).where("total > 1").select("norm_bytes")
    by_prefix = shapes.join(by_length, "norm_bytes", "left_semi").where("n > 1").drop("n")
    if all_digests:
        survivors = rows.join(by_prefix, ["norm_bytes", "prefix_hash"], "left_semi")
        full = rows
    else:
        ids = rows.join(by_prefix, ["norm_bytes", "prefix_hash"], "left_semi").select("doc_id").distinct()
        read = docs.join(ids.select(F.col("doc_id").alias("__id")), F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
        survivors = stored(facts(read, id_col, text_col), "exact_survivors")
        settled = rows.join(ids, rows.doc_id.eqNullSafe(ids.doc_id), "left_anti")
        full = settled.unionByName(survivors)
    groups = survivors.groupBy("norm_bytes", "prefix_hash", "text_sha256").agg(
        F.min(F.struct((-F.col("n_points")).alias("short"), F.col("doc_id").isNull().alias("unnamed"), "doc_id")).alias("best"), F.count("*").alias("size")
    ).where("size > 1").select(
        F.col("text_sha256").alias("digest"), F.col("best.doc_id").alias("best_id"), F.col("size").alias("size")
    )
    joined = full.join(groups, full.text_sha256 == groups.digest, "left")
    return joined.select(
        "doc_id",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("digest").isNull() | F.col("doc_id").eqNullSafe(F.col("best_id"))).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
