"""Declarative exports: filter, map, format, blank, clean, split and write."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.standard import ConfigError, spark_format

SIGNED = "computed:signed_amount"
#: Tables that may be exported, the columns their filters name, and what a spec must have.
FILTERS = {
    "FlatTransaction": {"account": "account_number", "date": "transaction_date", "statement": None},
    "FactTransaction": {"account": "id_account", "date": "id_date", "statement": "id_statement"},
    "FactBalance": {"account": "id_account", "date": "id_date", "statement": None},
    "DimStatement": {"account": "id_account", "date": "statement_date", "statement": "id_statement"},
    "DimAccount": {"account": "id_account", "date": None, "statement": None},
    "DimDate": {"account": None, "date": "id_date", "statement": None},
    "GapReport": {"account": "account_number", "date": "statement_date", "statement": None},
}
SECTIONS = ("meta", "export", "columns", "format", "sanitise")


@dataclass(frozen=True)
class Spec:
    """What an export holds and how it is written."""

    table: str
    columns: tuple[tuple[str, str], ...]
    format: str = "csv"
    split_by_statement: bool = False
    date_format: str | None = None
    float_precision: int | None = None
    invert_polarity: bool = False
    blank_zeros: bool = False
    strip_chars: str = ""

    def __post_init__(self):
        if self.table not in FILTERS:
            raise ConfigError(f"table {self.table!r} can't be exported")
        if self.format not in ("csv", "xlsx"):
            raise ConfigError(f"unknown format {self.format!r}")
        if not self.columns:
            raise ConfigError("no columns")
        for _, source in self.columns:
            if source.startswith("computed:") and source != SIGNED:
                raise ConfigError(f"unknown computed column {source!r}")


def load(path: str | Path) -> Spec:
    """A spec from TOML; all five sections must be there."""
    with open(path, "rb") as f:
        return from_dict(tomllib.load(f))


def from_dict(raw: dict) -> Spec:
    missing = [s for s in SECTIONS if s not in raw]
    if missing:
        raise ConfigError(f"sections missing: {', '.join(missing)}")
    return Spec(raw["meta"]["source_table"], tuple(raw["columns"].items()), raw["export"].get("format", "csv"), raw["export"].get("split_by_statement", False), raw["format"].get("date_format"),
                raw["format"].get("float_precision"), raw["format"].get("invert_polarity", False), raw["format"].get("blank_zeros", False), raw["sanitise"].get("strip_chars", ""))


#: Bank upload formats.
THREE_COLUMN = Spec("FlatTransaction", (("Date", "transaction_date"), ("Description", "transaction_desc"), ("Amount", SIGNED)), date_format="%d/%m/%Y", float_precision=2,
                    strip_chars="!@#$%^&*(),.?\":{}|<>")
FOUR_COLUMN = replace(THREE_COLUMN, columns=(("Date", "transaction_date"), ("Description", "transaction_desc"), ("Credit", "value_in"), ("Debit", "value_out")), blank_zeros=True)


def filtered(df: DataFrame, table: str, account: str | None = None, since=None, until=None, statement: str | None = None) -> DataFrame:
    """Rows of an account, of a range of days and of a statement; a filter the table has no column for is an error."""
    names = FILTERS[table]
    for kind, value, op in (("account", account, "eq"), ("date", since, "ge"), ("date", until, "le"), ("statement", statement, "eq")):
        if value is None:
            continue
        if names[kind] is None:
            raise ConfigError(f"{table} has no column for a filter by {kind}")
        c = F.col(names[kind])
        df = df.where(c == value if op == "eq" else c >= F.lit(value).cast("date") if op == "ge" else c <= F.lit(value).cast("date"))
    return df


def mapped(df: DataFrame, spec: Spec, keep: tuple[str, ...] = ()) -> DataFrame:
    """The export's columns under their names, dates formatted, zeros blanked and texts cleaned as the spec says."""
    out = []
    for name, source in spec.columns:
        if source == SIGNED:
            c, kind = F.col("value_in") - F.col("value_out"), T.DoubleType()
            c = -c if spec.invert_polarity else c
        else:
            if source not in df.columns:
                raise ConfigError(f"{spec.table} has no column {source!r}")
            c, kind = F.col(source), df.schema[source].dataType
        if isinstance(kind, T.NumericType):
            if spec.float_precision is not None and isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
                c = F.round(c, spec.float_precision)
            if spec.blank_zeros:
                c = F.nullif(c, F.lit(0).cast(kind))
        elif isinstance(kind, (T.DateType, T.TimestampType)):
            if spec.date_format and spec.format == "csv":
                c = F.date_format(c, spark_format(spec.date_format))
        elif isinstance(kind, T.StringType) and spec.strip_chars:
            c = F.translate(c, spec.strip_chars, "")
        out.append(c.alias(name))
    return df.select(*(F.col(k).alias(f"__{k}") for k in keep), *out)


def split_names(statements: DataFrame) -> DataFrame:
    """A file name for each statement: its account and date, numbered where several share both."""
    w = Window.partitionBy("id_account", "statement_date")
    n = F.count("*").over(w)
    number = F.row_number().over(w.orderBy("id_statement"))
    base = F.concat_ws("_", "id_account", F.date_format("statement_date", "yyyyMMdd"))
    return statements.select("id_statement", "id_account", "statement_date", F.when(n > 1, F.concat_ws("_", base, number.cast("string"))).otherwise(base).alias("file_name"))


def fixed(df: DataFrame, precision: int) -> DataFrame:
    """Doubles as text with a fixed number of decimals; nulls stay."""
    return df.select(*(F.when(F.col(f.name).isNotNull(), F.format_string(f"%.{precision}f", f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema))


def write(df: DataFrame, path: str, precision: int = 2) -> None:
    """Quoted CSV files with a header, doubles at a fixed number of decimals."""
    fixed(df, precision).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def export(df: DataFrame, spec: Spec, path: str, statements: DataFrame | None = None, **filters) -> DataFrame:
    """Run a spec over its table and write it as CSV; one folder for each statement if it splits.  A spec for another format is an error."""
    if spec.format != "csv":
        raise ConfigError(f"no writer for format {spec.format!r}")
    precision = 2 if spec.float_precision is None else spec.float_precision
    rows = filtered(df, spec.table, **filters)
    if not spec.split_by_statement:
        out = mapped(rows, spec)
        write(out, path, precision)
        return out
    rows = rows.join(split_names(statements).select("id_statement", "file_name"), "id_statement")
    out = mapped(rows, spec, ("file_name",)).withColumnRenamed("__file_name", "file_name")
    fixed(out, precision).write.mode("overwrite").option("header", True).option("quoteAll", True).partitionBy("file_name").csv(path)
    return out
