"""Keyed changes of tables and what dangling keys they leave."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key isn't new, then all new rows; new rows are cast to the old schema."""
    cast = new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema))
    return old.join(cast.select(*keys).distinct(), keys, "left_anti").unionByName(cast)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't among those of ``gone``."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and the new ones whose key is new, one for each key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


@dataclass(frozen=True)
class Link:
    """A column whose values must be keys of another table."""

    table: str
    column: str
    parent: str
    key: str


#: The links between raw tables.
LINKS = (
    Link("checks_and_balances", "ID_BATCHLINE", "batch_lines", "ID_BATCHLINE"),
    Link("checks_and_balances", "ID_BATCH", "batch_heads", "ID_BATCH"),
    Link("statement_heads", "ID_BATCHLINE", "batch_lines", "ID_BATCHLINE"),
    Link("statement_lines", "ID_STATEMENT", "statement_heads", "ID_STATEMENT"),
    Link("batch_lines", "ID_BATCH", "batch_heads", "ID_BATCH"),
)
PARENTS_FIRST = ("batch_heads", "batch_lines", "statement_heads", "statement_lines", "checks_and_balances")


def orphans(raw: dict[str, DataFrame], link: Link) -> DataFrame:
    """Rows of a table whose link is set but leads nowhere."""
    parents = raw[link.parent].select(F.col(link.key).alias(link.column)).distinct()
    return raw[link.table].where(F.col(link.column).isNotNull()).join(parents, link.column, "left_anti")


def report(raw: dict[str, DataFrame]) -> DataFrame:
    """For each link: how many rows dangle and the first ten distinct values."""
    out = None
    for x in (x for x in LINKS if x.table in raw and x.parent in raw):
        lost = orphans(raw, x).groupBy(F.col(x.column).cast("string").alias("id")).agg(F.count("*").alias("n"))
        row = first_ten(lost)
        row = row.select(F.lit(x.table).alias("table_name"), F.lit(x.column).alias("fk_column"), F.lit(x.parent).alias("parent_table"), "orphans", "first_ids")
        out = row if out is None else out.unionByName(row)
    return out


def first_ten(lost: DataFrame) -> DataFrame:
    """Sum of ``n`` and the ten smallest ids; no list longer than ten is gathered."""
    ten = lost.orderBy("id").limit(10).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("first_ids"))
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("orphans")).join(ten)


def cleaned(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Raw tables without dangling rows, links followed until a full pass over the fixed links is done.

    Parents come before their children, so rows that dangle only because their
    parent went are found in the same pass."""
    out = dict(raw)
    for name in PARENTS_FIRST:
        for x in LINKS:
            if x.table == name and name in out and x.parent in out:
                parents = out[x.parent].select(F.col(x.key).alias(x.column)).distinct().withColumn("__known", F.lit(True))
                out[name] = out[name].join(parents, x.column, "left").where(F.col("__known") | F.col(x.column).isNull()).select(*out[name].columns)
    return out
