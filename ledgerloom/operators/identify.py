"""Which configuration a document belongs to: the first whose probe finds something."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.regexlib import java


@dataclass(frozen=True)
class Probe:
    """A configuration's mark in a text."""

    key: str
    pattern: str


def search(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """The first match of a pattern in a text, or null."""
    return df.withColumn(out, F.nullif(F.regexp_extract(F.col(text), java(pattern), 0), F.lit("")))


def identify(df: DataFrame, text: str, probes: list[Probe], out: str = "config") -> DataFrame:
    """The key of the first probe, in their order, that matches; null if none does."""
    hit = F.coalesce(*(F.when(F.col(text).rlike(java(p.pattern)), F.lit(p.key)) for p in probes)) if probes else F.lit(None).cast("string")
    return df.withColumn(out, hit)


def locations(pages: DataFrame, spots: DataFrame, exclude_last: int = 0) -> DataFrame:
    """Every location with a page, and each without one on all pages that none with a page has claimed.

    ``pages`` has ``doc_id, n_pages``; ``spots`` has ``doc_id, location, page`` (null: any).  The last pages may be left out."""
    fixed = spots.where("page is not null").select("doc_id", "location", "page")
    open_ones = spots.where("page is null").select("doc_id", "location").join(pages.where(F.col("n_pages") > exclude_last), "doc_id")
    spread = open_ones.select("doc_id", "location", F.explode(F.sequence(F.lit(1), (F.col("n_pages") - exclude_last).cast("int"))).alias("page"))
    free = spread.join(fixed.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    return fixed.unionByName(free.select("doc_id", "location", F.col("page").cast(fixed.schema["page"].dataType).alias("page")))
