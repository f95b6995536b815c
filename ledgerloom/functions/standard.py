"""Standard fields: configured columns to the columns that every statement has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.fields import DECIMAL
from ledgerloom.operators.fill import forward, running


class ConfigError(ValueError):
    """A configuration that can't be applied."""


@dataclass(frozen=True)
class Reference:
    """Where a statement type has a standard field."""

    statement_type: str
    field: str | None = None
    concat: tuple[str, ...] = ()
    default: str | None = None
    format: str | None = None
    terminator: str | None = None
    multiplier: float = 1.0
    exclude_negative: bool = False
    exclude_positive: bool = False


@dataclass(frozen=True)
class Standard:
    """A standard field of a section, by statement type."""

    name: str
    type: str = "string"
    vital: bool = False
    references: tuple[Reference, ...] = ()


#: Date directives and their letters in Spark's patterns.
DIRECTIVES = {"%d": "dd", "%-d": "d", "%m": "MM", "%-m": "M", "%B": "MMMM", "%b": "MMM", "%Y": "yyyy", "%y": "yy", "%H": "HH", "%M": "mm", "%S": "ss", "%A": "EEEE", "%a": "EEE", "%j": "DDD"}


def spark_format(directives: str) -> str:
    """A strftime format as a Spark date pattern, letters quoted."""
    out, at, quoted = "", 0, ""
    while at < len(directives):
        d = next((directives[at : at + n] for n in (3, 2) if directives[at : at + n] in DIRECTIVES), None)
        if d:
            out, quoted = out + (f"'{quoted}'" if quoted else "") + DIRECTIVES[d], ""
        elif directives[at].isalpha():
            quoted += directives[at]
        else:
            out, quoted = out + (f"'{quoted}'" if quoted else "") + directives[at], ""
        at += len(d or " ")
    return out + (f"'{quoted}'" if quoted else "")


def cut_at(v: Column, terminator: str) -> Column:
    """The text before a literal terminator that doesn't begin it."""
    at = F.instr(v, terminator)
    return F.when(at > 1, F.substring(v, F.lit(1), at - 1)).otherwise(v)


def amount(v: Column, ref: Reference) -> Column:
    """A decimal with excluded signs as 0, null as 0, times the multiplier."""
    n = v.try_cast("double")
    if ref.exclude_negative:
        n = F.when(n < 0, 0.0).otherwise(n)
    if ref.exclude_positive:
        n = F.when(n > 0, 0.0).otherwise(n)
    return (F.coalesce(n, F.lit(0.0)) * F.lit(float(ref.multiplier))).cast(DECIMAL)


def date(v: Column, directives: str) -> Column:
    """A date by format, blanks optional; else the last three words of the text by the same format."""
    form = spark_format(directives).replace(" ", "").replace("dd", "d")  # one digit will do
    parse = lambda c: F.try_to_date(F.replace(c, F.lit(" "), F.lit("")), form) if hasattr(F, "try_to_date") else F.try_to_timestamp(F.replace(c, F.lit(" "), F.lit("")), F.lit(form)).cast("date")
    words = F.split(v, " ")
    tail = F.array_join(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3)), " ")
    return F.coalesce(parse(v), parse(tail))


def map_fields(df: DataFrame, standards: list[Standard], statement_type: str, by: list[str], order: list[str]) -> DataFrame:
    """Add every standard field of a section; a vital one without reference raises ``ConfigError``."""
    for s in standards:
        ref = next((r for r in s.references if r.statement_type == statement_type), None)
        if ref is None:
            if s.vital:
                raise ConfigError(f"{s.name} has no reference for statement type {statement_type}")
            df = df.withColumn(s.name, F.lit(None).cast("string"))
            continue
        v = F.concat(*map(F.col, ref.concat)) if ref.concat else F.col(ref.field) if ref.field else F.lit(ref.default)
        if ref.terminator:
            v = cut_at(v, ref.terminator)
        if s.type == "numeric":
            v = amount(v, ref)
        elif s.type == "date" and ref.format:
            v = forward(date(v, ref.format), by, order)
        df = df.withColumn(s.name, v)
    return df


def line_columns(lines: DataFrame, heads: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Movement, credit or debit, and the balance that runs on from the statement's opening balance.

    A line that moves nothing counts as a debit."""
    moved = (F.col("STD_TRANSACTION_PAYMENTS_IN") - F.col("STD_TRANSACTION_PAYMENTS_OUT")).cast(DECIMAL)
    rows = lines.join(heads.select(key, F.col("STD_OPENING_BALANCE").alias("__opening")), key).withColumn("STD_TRANSACTION_MOVEMENT", moved)
    balance = (F.col("__opening") + running(F.col("STD_TRANSACTION_MOVEMENT"), [key], order)).cast(DECIMAL)
    return rows.withColumns({"STD_RUNNING_BALANCE": balance, "STD_CD": F.when(F.col("STD_TRANSACTION_MOVEMENT") > 0, "C").otherwise("D")}).drop("__opening")


def ids(df: DataFrame, pages: str = "first_page") -> DataFrame:
    """A statement's identity: SHA-512 of its first page's text."""
    return df.withColumn("ID_STATEMENT", F.sha2(F.col(pages), 512))
