"""The star schema: calendar, accounts, statements, transactions and the dense daily balance.

Every function maps DataFrames to a DataFrame.  Money is decimal until the
last cast to double, windows have total orders, and dimensions carry no
broadcast hint: Spark broadcasts a side when its measured size allows it.
``build`` keeps each table once it is made; the next ones scan it."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.fill import backward, forward
from ledgerloom.operators.numbering import dense_key
from ledgerloom.plans.kept import Keeper
from ledgerloom.plans.lazy import Tables

Keep = Callable[[Callable[[], DataFrame]], DataFrame]


def date_range(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """First transaction date and last statement date over lines that have a statement."""
    return lines.join(heads.select("ID_STATEMENT", "STD_STATEMENT_DATE"), "ID_STATEMENT").agg(F.min("STD_TRANSACTION_DATE").alias("lo"), F.max("STD_STATEMENT_DATE").alias("hi"))


def calendar_columns(spine: DataFrame, d: str = "id_date") -> DataFrame:
    """Calendar attributes of each day.

    ``quarter`` and ``quarter_name`` hold the month, as readers of the table
    expect; weeks start on Monday and count from 0."""
    day = F.col(d)
    month, last = F.month(day), (F.last_day(day) == day)
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    flag = lambda c: c.cast("long")
    return spine.select(
        "date_int", day.alias("id_date"), F.date_format(day, "dd/MM/yyyy").alias("date_local_format"), F.date_format(day, "yyyyMMdd").cast("long").alias("date_integer"),
        F.year(day).cast("long").alias("year"), (F.year(day) % 100).cast("long").alias("year_short"), month.cast("long").alias("quarter"), F.concat(F.lit("Q"), month.cast("string")).alias("quarter_name"),
        month.cast("long").alias("month_number"), F.date_format(day, "MM").alias("month_number_padded"), F.date_format(day, "MMMM").alias("month_name"), F.date_format(day, "MMM").alias("month_abbrv"),
        F.date_format(day, "yyyyMM").cast("long").alias("period"), week.cast("long").alias("week"), (F.year(day) * 100 + week).cast("long").alias("year_week"),
        F.dayofmonth(day).cast("long").alias("day_of_month"), F.dayofyear(day).cast("long").alias("day_of_year"), F.dayofweek(day).cast("long").alias("day_of_week"),
        F.date_format(day, "EEEE").alias("weekday"), F.date_format(day, "EEE").alias("weekday_abbrv"), F.left(F.date_format(day, "EEEE"), F.lit(1)).alias("weekday_initial"),
        flag(last).alias("is_last_day_of_month"), flag(last & (month % 3 == 0)).alias("is_last_day_of_quarter"), flag(last & (month == 12)).alias("is_last_day_of_year"),
        flag(F.weekday(day) < 5).alias("is_weekday"))


def dim_date(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """A row for each day of the range, numbered from 1; empty for empty raw tables."""
    ends = date_range(heads, lines).where("lo is not null")
    days = ends.select("lo", F.explode(F.sequence("lo", F.greatest("lo", "hi"))).alias("id_date"))
    return calendar_columns(days.select((F.datediff("id_date", "lo") + 1).cast("long").alias("date_int"), "id_date"))


def dim_account(heads: DataFrame, keep: Keep) -> DataFrame:
    """The latest statement's details of each account; ties go to the larger statement id."""
    latest = Window.partitionBy("ID_ACCOUNT").orderBy(F.desc("STD_STATEMENT_DATE"), F.desc("ID_STATEMENT"))
    top = heads.where("ID_ACCOUNT is not null").withColumn("rn", F.row_number().over(latest)).where("rn = 1")
    rows = top.select(F.col("ID_ACCOUNT").alias("id_account"), F.col("STD_COMPANY").alias("company"), F.col("STD_ACCOUNT").alias("account_type"), F.col("STD_ACCOUNT_NUMBER").alias("account_number"),
                      F.col("STD_SORTCODE").alias("sortcode"), F.col("STD_ACCOUNT_HOLDER").alias("account_holder"), F.col("STD_CURRENCY").alias("currency"))
    return dense_key(rows, "account_int", "id_account", keep).select("account_int", *rows.columns)


def dim_statement(heads: DataFrame, batch_lines: DataFrame, accounts: DataFrame, keep: Keep) -> DataFrame:
    """Statements with the batch line that brought them in."""
    lines = batch_lines.select("ID_BATCHLINE", F.col("ID_BATCH").alias("id_batch"), F.col("STD_FILENAME").alias("filename"), F.col("STD_UPDATETIME").alias("batch_time"))
    rows = heads.join(lines, "ID_BATCHLINE").join(accounts.select(F.col("id_account").alias("account_key"), "account_int"), F.col("ID_ACCOUNT") == F.col("account_key"))
    rows = rows.select(
        F.col("ID_STATEMENT").alias("id_statement"), "account_int", F.col("account_key").alias("id_account"), "id_batch", F.col("STD_COMPANY").alias("company"), F.col("STD_ACCOUNT").alias("account_type"),
        F.col("STD_ACCOUNT_NUMBER").alias("account_number"), F.col("STD_SORTCODE").alias("sortcode"), F.col("STD_ACCOUNT_HOLDER").alias("account_holder"), F.col("STD_STATEMENT_DATE").alias("statement_date"),
        *(F.col(f"STD_{c}").cast("double").alias(c.lower()) for c in ("OPENING_BALANCE", "PAYMENTS_IN", "PAYMENTS_OUT", "CLOSING_BALANCE")),
        F.col("STD_STATEMENT_TYPE").alias("statement_type"), F.col("STD_CURRENCY").alias("currency"), "filename", "batch_time")
    return dense_key(rows, "statement_int", "id_statement", keep).select("statement_int", *rows.columns)


def fact_transaction(lines: DataFrame, statements: DataFrame, dates: DataFrame, keep: Keep) -> DataFrame:
    """Transactions of known statements on days of the calendar; lines on other days are left out."""
    d = dates.select("date_int", "id_date")
    s = statements.select("statement_int", "account_int", "id_account", "id_statement")
    rows = lines.withColumnRenamed("ID_STATEMENT", "line_statement").join(s, F.col("line_statement") == F.col("id_statement")).join(d, F.col("STD_TRANSACTION_DATE") == F.col("id_date"))
    pin, pout = F.col("STD_TRANSACTION_PAYMENTS_IN").cast("double"), F.col("STD_TRANSACTION_PAYMENTS_OUT").cast("double")
    rows = rows.select(
        F.col("ID_TRANSACTION").alias("id_transaction"), "statement_int", "account_int", "date_int", "id_date", "id_account", "id_statement", F.col("STD_TRANSACTION_NUMBER").alias("transaction_number"),
        F.col("STD_CD").alias("transaction_credit_or_debit"), F.col("STD_TRANSACTION_TYPE").alias("transaction_type"), F.col("STD_TRANSACTION_TYPE_CD").alias("transaction_type_cd"),
        F.col("STD_TRANSACTION_DESC").alias("transaction_desc"), F.col("STD_OPENING_BALANCE").cast("double").alias("opening_balance"), pin.alias("value_in"), pout.alias("value_out"), (pin - pout).alias("value"))
    return dense_key(rows, "transaction_int", "id_transaction", keep).select("transaction_int", *rows.columns)


def daily(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """Movement and largest closing balance of each account and day with transactions."""
    closing = lines.select(F.col("ID_TRANSACTION").alias("id_transaction"), "STD_CLOSING_BALANCE", "STD_TRANSACTION_PAYMENTS_IN", "STD_TRANSACTION_PAYMENTS_OUT")
    rows = facts.select("id_transaction", "account_int", "date_int").join(closing, "id_transaction")
    moved = F.sum(F.col("STD_TRANSACTION_PAYMENTS_IN") - F.col("STD_TRANSACTION_PAYMENTS_OUT"))
    return rows.groupBy("account_int", "date_int").agg(F.max("STD_CLOSING_BALANCE").cast("double").alias("closing_balance"), moved.cast("double").alias("movement"))


def bookends(days: DataFrame) -> DataFrame:
    """First and last day with transactions of each account."""
    return days.groupBy("account_int").agg(F.min("date_int").alias("first_did"), F.max("date_int").alias("last_did"))


def fact_balance(dates: DataFrame, accounts: DataFrame, days: DataFrame) -> DataFrame:
    """A row for each account and calendar day.

    The closing balance is carried forward, the opening balance is the next
    known closing balance from the day on; both are null before the first
    transaction.  The grid is made by giving each account the whole calendar as
    one array: a row an account moves, and the product is unfolded where the
    account's window runs.  The array holds one entry a day of the calendar,
    whatever the number of rows; it is a table of one row, so the join without
    a condition below makes one row an account."""
    calendar = dates.agg(F.sort_array(F.collect_list(F.struct("date_int", "id_date"))).alias("calendar"))
    ends = accounts.select("account_int", "id_account").join(bookends(days), "account_int", "left")
    grid = ends.join(calendar).select("account_int", "id_account", "first_did", "last_did", F.explode("calendar").alias("c")).select("*", "c.date_int", "c.id_date").drop("c")
    grid = grid.join(days, ["account_int", "date_int"], "left")
    early, late = F.col("date_int") < F.col("first_did"), F.col("date_int") > F.col("last_did")
    seen = F.when(~F.coalesce(early, F.lit(False)), F.lit(1))
    by, order = ["account_int"], ["date_int"]
    return grid.select(
        "date_int", "account_int", "id_date", "id_account",
        F.when(seen == 1, backward(F.col("closing_balance"), by, order)).alias("opening_balance"),
        F.when(seen == 1, forward(F.col("closing_balance"), by, order)).alias("closing_balance"),
        F.coalesce("movement", F.lit(0.0)).alias("movement"), F.coalesce(early | late, F.lit(False)).cast("long").alias("outside_date"))


def build(raw: Mapping[str, DataFrame], keeper: Keeper | None = None) -> Tables:
    """All five tables of the mart and the daily totals (``daily``) from the raw tables; each is made and kept when first asked for."""
    heads, lines = raw["statement_heads"], raw["statement_lines"]
    keeper = keeper or Keeper(heads.sparkSession)
    under = lambda name: lambda make: keeper(name, make)
    return Tables({
        "DimDate": lambda m: keeper("DimDate", lambda: dim_date(heads, lines)),
        "DimAccount": lambda m: dim_account(heads, under("DimAccount")),
        "DimStatement": lambda m: dim_statement(heads, raw["batch_lines"], m["DimAccount"], under("DimStatement")),
        "FactTransaction": lambda m: fact_transaction(lines, m["DimStatement"], m["DimDate"], under("FactTransaction")),
        "FactBalance": lambda m: keeper("FactBalance", lambda: fact_balance(m["DimDate"], m["DimAccount"], m["daily"])),
    }, {"daily": lambda m: keeper("daily", lambda: daily(m["FactTransaction"], lines))})


def save(mart: Mapping[str, DataFrame], database: str = "default") -> None:
    """Write the mart as tables in order of dependence, facts sorted for the account scans that read them."""
    for name, df in mart.items():
        df.write.mode("overwrite").saveAsTable(f"{database}.{name}")
