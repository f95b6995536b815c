"""Reading of mart tables and views by name, and the files made of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans import export

#: What may be read by name, and which of it has a batch-scoped view.
TABLES = frozenset({"DimDate", "DimAccount", "DimStatement", "FactTransaction", "FactBalance", "FlatTransaction", "GapReport"})
BATCHED = frozenset(TABLES - {"GapReport"})
SINGLE, MULTI = ("FlatTransaction",), ("DimDate", "DimAccount", "DimStatement", "FactTransaction", "FactBalance", "GapReport")
DATE, DATETIME = r"^\d{4}-\d{2}-\d{2}\z", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?\z"


def checked(name: str, allowed: frozenset[str] = TABLES) -> str:
    """The name, if it is an allowed one."""
    if name not in allowed:
        raise ValueError(f"{name!r} is not a table that may be read")
    return name


def register(tables: Mapping[str, DataFrame]) -> None:
    """Make mart tables and views readable by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def scan(spark: SparkSession, name: str, batch: str | None = None) -> DataFrame:
    """A table by name, or the rows of a batch from its batch-scoped view."""
    if batch is None:
        return spark.table(checked(name))
    return spark.sql(f"SELECT * FROM {checked(name, BATCHED)}Batch WHERE batch_id = :batch", args={"batch": batch})


def gaps(report: DataFrame) -> DataFrame:
    return report.where(F.col("gap_flag") == "GAP")


def collection(spark: SparkSession, preset: str, batch: str | None = None) -> dict[str, DataFrame]:
    """The tables of a preset, ``single`` or ``multi``."""
    names = {"single": SINGLE, "multi": MULTI}[preset]
    return {n: scan(spark, n, batch if n in BATCHED else None) for n in names}


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").cast("long").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def sniffed(df: DataFrame) -> DataFrame:
    """Text columns whose values all look like ISO dates or times, as such; one pass decides for all."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    known = df.agg(*(F.every(F.coalesce(F.col(c).rlike(p), F.lit(True))).alias(f"{c}|{k}") for c in texts for k, p in (("d", DATE), ("t", DATETIME))), *(F.count(c).alias(f"{c}|n") for c in texts)).first().asDict()
    turn = {c: F.col(c).try_cast("date") if known[f"{c}|d"] else F.try_to_timestamp(F.col(c)) for c in texts if known[f"{c}|n"] and (known[f"{c}|d"] or known[f"{c}|t"])}
    return df.withColumns(turn) if turn else df


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object, nulls kept; lines of a JSON file."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON objects, one a line, in as many files as there are partitions."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def feed(spark: SparkSession, path: str) -> None:
    """Both presets as CSV in folders that stay the same."""
    for preset in ("single", "multi"):
        for name, df in collection(spark, preset).items():
            export.write(df, f"{path}/{preset}/{name}")
