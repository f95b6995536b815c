"""The field language: raw cell text to a typed value, step by step.

Each step adds ``value_<step>``, ``success_<step>`` and ``error_<step>`` (a value
succeeds if it isn't empty); ``check`` folds them into ``value, success, error,
hard_fail``.  All steps are Column expressions, so a field costs one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.currency import CURRENCIES, Currency
from ledgerloom.functions.regexlib import java

DECIMAL = "decimal(16,4)"
MAX_CHARS = 999
STEPS = ("strip", "pattern", "cast", "trim")


@dataclass(frozen=True)
class Modifier:
    """What an affix of a number means, and which signs count."""

    prefix: str | None = None
    suffix: str | None = None
    multiplier: float = 1.0
    exclude_negative: bool = False
    exclude_positive: bool = False


@dataclass(frozen=True)
class Offset:
    """Take the value some columns to the right of the cell that matched."""

    columns: int
    field: Field


@dataclass(frozen=True)
class Field:
    """One field of a statement: where its text stands and how it is read."""

    name: str
    type: str = "string"
    column: int = 0
    cell: tuple[int, int] | None = None
    vital: bool = False
    strip_start: str | None = None
    strip_end: str | None = None
    pattern: str | None = None
    group: int | None = None
    max_length: int | None = None
    modifier: Modifier | None = None
    currency: str | None = None
    offset: Offset | None = None

    @property
    def spec(self) -> Currency | None:
        return CURRENCIES[self.currency] if self.currency and self.type in ("numeric", "currency") else None


def full_pattern(field: Field) -> str:
    """The explicit pattern, or the currency's with the affixes allowed at both ends, or anything."""
    if field.pattern is not None:
        return field.pattern
    if field.spec is None:
        return ".+"
    m, pattern = field.modifier or Modifier(), field.spec.pattern
    if m.prefix is not None:
        pattern = pattern.replace("^", rf"^({m.prefix})?\s?")
    if m.suffix is not None:
        pattern = pattern.replace("$", rf"\s?({m.suffix})?$")
    return pattern


def stripped(raw: Column, field: Field) -> Column:
    v = F.coalesce(raw, F.lit(""))
    if field.strip_start:
        v = F.ltrim(v, F.lit(field.strip_start))
    if field.strip_end:
        v = F.rtrim(v, F.lit(field.strip_end))
    if field.spec:
        for s in (*field.spec.symbols, *field.spec.thousands):
            v = F.replace(v, F.lit(s), F.lit(""))
        v = F.regexp_replace(F.regexp_replace(v, r"(?U)\s", ""), r"\.+\z", "")
    return v


def number(v: Column, field: Field) -> Column:
    """The amount as a double: affix, decimal mark, multiplier, excluded signs (those become 0)."""
    spec, m = field.spec, field.modifier
    plain = F.replace(v, F.lit(spec.decimal), F.lit(".")) if spec and spec.decimal != "." else v
    n = plain.try_cast("double")
    if m:
        times = F.lit(float(m.multiplier))
        if m.prefix:
            n = F.when(F.startswith(v, F.lit(m.prefix)), F.ltrim(plain, F.lit(m.prefix)).try_cast("double") * times).otherwise(n)
        elif m.suffix:
            n = F.when(F.endswith(v, F.lit(m.suffix)), F.rtrim(plain, F.lit(m.suffix)).try_cast("double") * times).otherwise(n)
        else:
            n = n * times
        if m.exclude_negative:
            n = F.when(n < 0, 0.0).otherwise(n)
        if m.exclude_positive:
            n = F.when(n > 0, 0.0).otherwise(n)
    return n


def step(df: DataFrame, name: str, value: Column) -> DataFrame:
    done = F.octet_length(F.coalesce(value, F.lit(""))) > 0
    return df.withColumn(f"value_{name}", value).withColumns({f"success_{name}": F.coalesce(done, F.lit(False)), f"error_{name}": F.when(~done, F.lit(f"{name} error"))})


def read(df: DataFrame, field: Field, raw: str = "value_raw") -> DataFrame:
    """All steps of a field over the text in column ``raw``."""
    df = step(df, "strip", stripped(F.col(raw), field))
    df = step(df, "pattern", F.coalesce(F.regexp_extract("value_strip", java(full_pattern(field)), field.group or 0), F.lit("")))
    if field.type in ("numeric", "currency"):
        df = step(df, "cast", number(F.col("value_pattern"), field).try_cast(DECIMAL).cast("string"))
    else:
        df = step(df, "cast", F.col("value_pattern"))
    trimmed = F.left(F.col("value_cast"), F.lit(field.max_length or MAX_CHARS)) if field.type == "string" else F.col("value_cast")
    return check(step(df, "trim", F.coalesce(trimmed, F.lit(""))), field)


def check(df: DataFrame, field: Field) -> DataFrame:
    """Success of all steps, the first error, and whether a vital field failed."""
    ok = F.col("success_strip")
    for s in STEPS[1:]:
        ok = ok & F.col(f"success_{s}")
    return df.withColumns({"field": F.lit(field.name), "vital": F.lit(field.vital), "value": F.col("value_trim"), "success": ok,
                           "error": F.coalesce(*(F.col(f"error_{s}") for s in STEPS)), "hard_fail": ~ok & F.lit(field.vital)})


RECORD = ("section", "location", "config", "row", "page", "field", "vital", "value", "success", "error", "hard_fail", "value_raw_offset", "value_raw", "value_strip")


def records(df: DataFrame, keys: list[str], section: str = "", location: str = "", config: str = "") -> DataFrame:
    """The long record of a field: fixed columns, empty texts as null."""
    fill = {"section": F.lit(section), "location": F.lit(location), "config": F.lit(config)}
    if "value_raw_offset" not in df.columns:
        fill["value_raw_offset"] = F.lit(None).cast("string")
    df = df.withColumns(fill)
    text = {"value", "error", "value_raw_offset", "value_raw", "value_strip", "section", "location", "config"}
    return df.select(*keys, *(F.nullif(F.col(c), F.lit("")).alias(c) if c in text else F.col(c) for c in RECORD if c not in keys))


def from_cell(grid: DataFrame, field: Field, keys: list[str]) -> DataFrame:
    """A summary grid's cell ``(row, column)`` as a record; grids without the row give none."""
    row, column = field.cell
    return read(grid.where(F.col("row") == row).withColumn("value_raw", F.get("cells", F.lit(column))), field)


def from_column(grid: DataFrame, fields: list[Field], keys: list[str]) -> DataFrame:
    """A transaction grid's columns as records, one for each row and field."""
    out = None
    for f in fields:
        part = read(grid.withColumn("value_raw", F.get("cells", F.lit(f.column))), f)
        if f.offset:
            part = with_offset(part, f)
        part = records(part, [*keys, "page", "row"])
        out = part if out is None else out.unionByName(part)
    return out


def with_offset(df: DataFrame, field: Field) -> DataFrame:
    """For rows whose own cell succeeded, the value of the cell some columns on; other rows go."""
    hit = df.where("success").withColumn("value_raw_offset", F.get("cells", F.lit(field.column + field.offset.columns)))
    keep = [c for c in hit.columns if not c.startswith(("value_", "success", "error")) and c not in ("value", "field", "vital", "hard_fail")]
    return read(hit.select(*keep, "value_raw", "value_raw_offset"), field.offset.field, "value_raw_offset").withColumn("field", F.lit(field.name))


def scoped(rows: DataFrame, scope: str = "all", transactions: bool = False) -> DataFrame:
    """Records of a scope: ``all``, ``success``, ``fail`` or ``hard_fail``; transaction tables are never cut."""
    if transactions or scope == "all":
        return rows
    return rows.where({"success": "success", "fail": "not success", "hard_fail": "hard_fail"}[scope])
