"""Checks and balances: what a statement states against what its lines add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.fields import DECIMAL


def totals(lines: DataFrame, key: str, order: str) -> DataFrame:
    """Sums, last running balance and counters of the lines of each statement."""
    add = lambda c: F.sum(c).cast(DECIMAL).alias(c)
    return lines.groupBy(key).agg(
        add("STD_TRANSACTION_PAYMENTS_IN"), add("STD_TRANSACTION_PAYMENTS_OUT"), add("STD_TRANSACTION_MOVEMENT"), F.max_by("STD_RUNNING_BALANCE", order).alias("STD_RUNNING_BALANCE"),
        F.count("*").alias("TRANSACTION_LINE_COUNT"), F.count_if(F.col("STD_TRANSACTION_DATE").isNull()).alias("TRANSACTION_LINES_WITH_NULL_DATE"),
        F.count_if(F.col("STD_TRANSACTION_DESC").isNull()).alias("TRANSACTION_LINES_WITH_NULL_DESC"))


def balance(heads: DataFrame, lines: DataFrame, key: str = "ID_STATEMENT", order: str = "STD_TRANSACTION_NUMBER") -> DataFrame:
    """One row a statement with its stated and added-up figures, five checks and the verdict.

    A statement whose four payment totals add up to nothing passes as it is; any
    other needs lines, all four balances and no line without date or description."""
    rows = heads.select(key, "STD_OPENING_BALANCE", "STD_PAYMENTS_IN", "STD_PAYMENTS_OUT", "STD_CLOSING_BALANCE").join(totals(lines, key, order), key, "left")
    rows = rows.withColumns({"STD_MOVEMENT": (F.col("STD_CLOSING_BALANCE") - F.col("STD_OPENING_BALANCE")).cast(DECIMAL), "STD_BALANCE_OF_PAYMENTS": (F.col("STD_PAYMENTS_IN") - F.col("STD_PAYMENTS_OUT")).cast(DECIMAL)})
    true = lambda c: F.coalesce(c, F.lit(False))
    moved = F.col("STD_PAYMENTS_IN") + F.col("STD_PAYMENTS_OUT") + F.col("STD_TRANSACTION_PAYMENTS_IN") + F.col("STD_TRANSACTION_PAYMENTS_OUT")
    rows = rows.withColumns({
        "BAL_PAYMENTS_IN": true(F.col("STD_PAYMENTS_IN") == F.col("STD_TRANSACTION_PAYMENTS_IN")),
        "BAL_PAYMENTS_OUT": true(F.col("STD_PAYMENTS_OUT") == F.col("STD_TRANSACTION_PAYMENTS_OUT")),
        "BAL_MOVEMENT": true((F.col("STD_MOVEMENT") == F.col("STD_TRANSACTION_MOVEMENT")) & (F.col("STD_TRANSACTION_MOVEMENT") == F.col("STD_BALANCE_OF_PAYMENTS"))),
        "BAL_CLOSING": true((F.col("STD_CLOSING_BALANCE") == F.col("STD_RUNNING_BALANCE")) | (moved == 0)),
        "ZERO_TRANSACTION_STATEMENT": true(moved == 0),
        **{c: F.coalesce(c, F.lit(0)) for c in ("TRANSACTION_LINE_COUNT", "TRANSACTION_LINES_WITH_NULL_DATE", "TRANSACTION_LINES_WITH_NULL_DESC")}})
    good = (F.col("TRANSACTION_LINE_COUNT") > 0) & F.col("BAL_PAYMENTS_IN") & F.col("BAL_PAYMENTS_OUT") & F.col("BAL_MOVEMENT") & F.col("BAL_CLOSING")
    good = good & (F.col("TRANSACTION_LINES_WITH_NULL_DATE") == 0) & (F.col("TRANSACTION_LINES_WITH_NULL_DESC") == 0)
    return rows.withColumn("SUCCESS", F.col("ZERO_TRANSACTION_STATEMENT") | good)


def detail(cab: DataFrame) -> DataFrame:
    """A line of text naming each failed check with its figures; empty if none failed."""
    lines, dates, descs = F.col("TRANSACTION_LINE_COUNT"), F.col("TRANSACTION_LINES_WITH_NULL_DATE"), F.col("TRANSACTION_LINES_WITH_NULL_DESC")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    delta = lambda a, b: F.round(F.col(a) - F.col(b), 2)
    text = F.concat_ws(
        " | ",
        F.when(dates > 0, say("NULL_DATES lines=", lines, " with_null_date=", dates)),
        F.when(descs > 0, say("NULL_DESCRIPTIONS lines=", lines, " with_null_description=", descs)),
        F.when(~F.col("BAL_PAYMENTS_IN"), say("BAL_PAYMENTS_IN stated=", F.col("STD_PAYMENTS_IN"), " extracted=", F.col("STD_TRANSACTION_PAYMENTS_IN"), " delta=", delta("STD_PAYMENTS_IN", "STD_TRANSACTION_PAYMENTS_IN"))),
        F.when(~F.col("BAL_PAYMENTS_OUT"), say("BAL_PAYMENTS_OUT stated=", F.col("STD_PAYMENTS_OUT"), " extracted=", F.col("STD_TRANSACTION_PAYMENTS_OUT"), " delta=", delta("STD_PAYMENTS_OUT", "STD_TRANSACTION_PAYMENTS_OUT"))),
        F.when(~F.col("BAL_MOVEMENT"), say("BAL_MOVEMENT movement=", F.col("STD_MOVEMENT"), " transaction_movement=", F.col("STD_TRANSACTION_MOVEMENT"), " balance_of_payments=", F.col("STD_BALANCE_OF_PAYMENTS"))),
        F.when(~F.col("BAL_CLOSING"), say("BAL_CLOSING stated=", F.col("STD_CLOSING_BALANCE"), " calculated=", F.col("STD_RUNNING_BALANCE"), " delta=", delta("STD_CLOSING_BALANCE", "STD_RUNNING_BALANCE"))))
    return cab.withColumn("detail", text)


def record(cab: DataFrame, batch_lines: DataFrame, key: str = "ID_STATEMENT") -> DataFrame:
    """The stored form of the checks, one row for each batch line of a statement."""
    b = batch_lines.select("ID_BATCHLINE", "ID_BATCH", key)
    pairs = {"OPENING_BALANCE": (F.col("STD_OPENING_BALANCE"), F.col("STD_RUNNING_BALANCE") - F.col("STD_TRANSACTION_MOVEMENT")), "PAYMENTS_IN": (F.col("STD_PAYMENTS_IN"), F.col("STD_TRANSACTION_PAYMENTS_IN")),
             "PAYMENTS_OUT": (F.col("STD_PAYMENTS_OUT"), F.col("STD_TRANSACTION_PAYMENTS_OUT")), "MOVEMENT": (F.col("STD_MOVEMENT"), F.col("STD_TRANSACTION_MOVEMENT")),
             "CLOSING_BALANCE": (F.col("STD_CLOSING_BALANCE"), F.col("STD_RUNNING_BALANCE"))}
    return cab.join(b, key).select(
        F.col("ID_BATCHLINE").alias("ID_CAB"), "ID_BATCHLINE", "ID_BATCH", (~F.col("ZERO_TRANSACTION_STATEMENT")).alias("HAS_TRANSACTIONS"),
        *(h.cast(DECIMAL).alias(f"STD_{n}_HEADS") for n, (h, _) in pairs.items()), *(x.cast(DECIMAL).alias(f"STD_{n}_LINES") for n, (_, x) in pairs.items()),
        F.col("BAL_PAYMENTS_IN").alias("CHECK_PAYMENTS_IN"), F.col("BAL_PAYMENTS_OUT").alias("CHECK_PAYMENTS_OUT"), F.col("BAL_MOVEMENT").alias("CHECK_MOVEMENT"), F.col("BAL_CLOSING").alias("CHECK_CLOSING"),
        *(F.col(c).cast("long").alias(c) for c in ("TRANSACTION_LINE_COUNT", "TRANSACTION_LINES_WITH_NULL_DATE", "TRANSACTION_LINES_WITH_NULL_DESC")))


def outcome(df: DataFrame) -> DataFrame:
    """``result`` and ``outcome`` from the error flags ``error_config, error_cab, error_data, error_other``."""
    c, b, d, o = (F.coalesce(F.col(f"error_{n}"), F.lit(False)) for n in ("config", "cab", "data", "other"))
    route = F.when(~c & ~b & ~d & ~o, "SUCCESS").when(b & ~d, "REVIEW CAB").when(c, "FAILURE CONFIG").when(d, "FAILURE DATA").otherwise("FAILURE OTHER")
    return df.withColumn("outcome", route).withColumn("result", F.substring_index("outcome", " ", 1))


def tallies(df: DataFrame, by: str) -> DataFrame:
    """Results of each batch by kind; a failure is exactly that result."""
    n = lambda r: F.count_if(F.col("result") == r)
    return df.groupBy(by).agg(F.count("*").alias("pdf_count"), n("FAILURE").alias("errors"), n("REVIEW").alias("reviews"), n("SUCCESS").alias("successes"))
