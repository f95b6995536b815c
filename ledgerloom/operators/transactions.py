"""Transactions that stretch over several rows: where they begin and end, and how rows become one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.regexlib import java
from ledgerloom.operators.fill import forward, island


@dataclass(frozen=True)
class Rule:
    """A field that must match a pattern."""

    field: str
    pattern: str


@dataclass(frozen=True)
class Bookend:
    """Which successful fields make a first row, and which a last one."""

    start_fields: tuple[str, ...]
    end_fields: tuple[str, ...]
    min_start: int = 1
    min_end: int = 1
    only_if: Rule | None = None


def exclude_rows(records: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """Drop all fields of rows in which any rule matches."""
    hit = F.lit(False)
    for r in rules:
        hit = hit | ((F.col("field") == r.field) & F.coalesce(F.col("value").rlike(java(r.pattern)), F.lit(False)))
    return records.join(records.where(hit).select(*keys).distinct(), keys, "left_anti") if rules else records


def flag_rows(records: DataFrame, bookends: list[Bookend], keys: list[str]) -> DataFrame:
    """Add ``transaction_start`` and ``transaction_end`` to every record of a row.

    A rule's extra condition, where the row has a value against it, rules out
    the row for its start and its end alike."""
    start, end = F.lit(False), F.lit(False)
    for b in bookends:
        count = lambda fs: F.count_if(F.col("field").isin(*fs) & F.col("success"))
        fine = F.lit(True) if b.only_if is None else ~F.coalesce(F.max((F.col("field") == b.only_if.field) & ~F.col("value").rlike(java(b.only_if.pattern))), F.lit(False))
        has = lambda fs: F.max(F.col("field").isin(*fs))
        start = start | (has(b.start_fields) & (count(b.start_fields) >= b.min_start) & fine)
        end = end | (has(b.end_fields) & (count(b.end_fields) >= b.min_end) & fine)
    flags = records.groupBy(*keys).agg(start.alias("transaction_start"), end.alias("transaction_end"))
    return records.join(flags, keys)


def stitch(records: DataFrame, fields: list[str], by: list[str], order: list[str], fill: list[str] = (), merge: list[str] = (), separator: str = " ") -> DataFrame:
    """Long records with flags to one wide row for each last row of a transaction.

    Rows are pivoted over the known fields, numbered by the starts before them,
    filled forward, joined by text over the transaction, and the last rows stay;
    rows before the first start go.  A transaction with two last rows gives two."""
    wide = records.groupBy(*by, *order, "transaction_start", "transaction_end").pivot("field", fields).agg(F.first("value", True))
    wide = wide.withColumn("transaction_number", island(F.col("transaction_start"), by, order)).where("transaction_number > 0")
    for f in fill:
        wide = wide.withColumn(f, forward(F.col(f), by, order))
    whole = Window.partitionBy(*by, "transaction_number").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for f in merge:
        wide = wide.withColumn(f, F.array_join(F.collect_list(f).over(whole), separator))
    return wide.where("transaction_end").drop("transaction_start", "transaction_end")
