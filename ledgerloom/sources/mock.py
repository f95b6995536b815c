"""A made-up ledger of any size; every value follows from row numbers, so it is the same each time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.fields import DECIMAL

ACCOUNTS = 5


def drawn(salt: str, *cols):
    """A number in [0, 1) drawn from columns."""
    return F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(1_000_003)) / 1_000_003


def make(spark: SparkSession, batches: int = 10, statements: int = 20, lines: int = 50) -> dict[str, DataFrame]:
    """Raw tables in the shape of the test workload: stated totals don't match the lines."""
    n = batches * statements
    s = spark.range(n).select(F.col("id").alias("s"), F.floor(F.col("id") / statements).alias("b"), F.pmod("id", F.lit(ACCOUNTS)).alias("a"))
    s = s.withColumn("day", F.date_add(F.add_months(F.lit("2024-01-01").cast("date"), F.col("b").cast("int")), (10 + 15 * drawn("day", "s")).cast("int")))
    money = lambda low, high, salt, *c: (low + (high - low) * drawn(salt, *c)).cast("decimal(16,2)").cast(DECIMAL)
    heads = s.select(
        F.format_string("ST%06d", "s").alias("ID_STATEMENT"), F.format_string("BT%03d_%d", "b", F.pmod("s", F.lit(statements)) + 1).alias("ID_BATCHLINE"), F.format_string("BANK_CURRENT_%08d", "a").alias("ID_ACCOUNT"),
        F.lit("BANK").alias("STD_COMPANY"), F.lit("MONTHLY").alias("STD_STATEMENT_TYPE"), F.lit("CURRENT").alias("STD_ACCOUNT"), F.lit(None).cast("string").alias("STD_CURRENCY"), F.lit("00-00-00").alias("STD_SORTCODE"),
        F.format_string("%08d", "a").alias("STD_ACCOUNT_NUMBER"), F.format_string("Holder %d", "a").alias("STD_ACCOUNT_HOLDER"), F.col("day").alias("STD_STATEMENT_DATE"),
        money(100, 5000, "open", "s").alias("STD_OPENING_BALANCE"), money(0, 9000, "in", "s").alias("STD_PAYMENTS_IN"), money(0, 9000, "out", "s").alias("STD_PAYMENTS_OUT"), money(100, 5000, "close", "s").alias("STD_CLOSING_BALANCE"))
    x = s.select("s", "day", F.explode(F.sequence(F.lit(1), F.lit(lines))).alias("n"))
    credit, value = drawn("cd", "s", "n") < 0.5, money(10, 1000, "value", "s", "n")
    rows = x.select(
        F.format_string("ST%06d.%d", "s", "n").alias("ID_TRANSACTION"), F.format_string("ST%06d", "s").alias("ID_STATEMENT"), F.lit(1).alias("STD_PAGE_NUMBER"),
        F.date_sub("day", (1 + 27 * drawn("back", "s", "n")).cast("int")).alias("STD_TRANSACTION_DATE"), F.col("n").cast("long").alias("STD_TRANSACTION_NUMBER"), F.when(credit, "C").otherwise("D").alias("STD_CD"),
        F.lit("CARD").alias("STD_TRANSACTION_TYPE"), F.lit("CD").alias("STD_TRANSACTION_TYPE_CD"), F.format_string("Line %d of %d", "n", "s").alias("STD_TRANSACTION_DESC"), F.lit(0).cast(DECIMAL).alias("STD_OPENING_BALANCE"),
        F.when(credit, value).otherwise(F.lit(0)).cast(DECIMAL).alias("STD_TRANSACTION_PAYMENTS_IN"), F.when(credit, F.lit(0)).otherwise(value).cast(DECIMAL).alias("STD_TRANSACTION_PAYMENTS_OUT"),
        money(100, 5000, "run", "s", "n").alias("STD_CLOSING_BALANCE"))
    lines_of = heads.select(F.split_part("ID_BATCHLINE", F.lit("_"), F.lit(1)).alias("ID_BATCH"), "ID_BATCHLINE", "ID_STATEMENT", F.split_part("ID_BATCHLINE", F.lit("_"), F.lit(2)).cast("long").alias("STD_BATCH_LINE"),
                            F.concat("ID_STATEMENT", F.lit(".pdf")).alias("STD_FILENAME"), "STD_ACCOUNT", F.col("STD_STATEMENT_DATE").cast("timestamp").alias("STD_UPDATETIME"))
    return {"statement_heads": heads, "statement_lines": rows, "batch_lines": lines_of, "batch_heads": lines_of.groupBy("ID_BATCH").agg(F.count("*").alias("STD_PDF_COUNT"))}
