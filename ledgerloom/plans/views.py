"""Views over the mart: flat, gap and batch-scoped."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.kept import Keeper
from ledgerloom.plans.lazy import Tables

DESC_CHARS = 25


def flat_transaction(m: dict[str, DataFrame]) -> DataFrame:
    """One wide row a transaction."""
    s = m["DimStatement"].select("statement_int", "statement_date", "filename")
    a = m["DimAccount"].select("account_int", "company", "account_type", "account_number", "sortcode", "account_holder")
    rows = m["FactTransaction"].join(s, "statement_int").join(a, "account_int")
    return rows.select(F.col("id_date").alias("transaction_date"), "statement_date", "filename", *a.columns[1:], "transaction_number", F.col("transaction_credit_or_debit").alias("CD"),
                       F.col("transaction_type").alias("type"), "transaction_desc", F.substring("transaction_desc", 1, DESC_CHARS).alias("short_desc"), "value_in", "value_out", "value")


def gap_report(heads: DataFrame) -> DataFrame:
    """Statements in order, flagged where one doesn't open at the last closing balance.

    The first statement of an account type and number is never a gap, nor is one without
    either; an unknown balance on either side is one."""
    w = Window.partitionBy("STD_ACCOUNT", "STD_ACCOUNT_NUMBER").orderBy("STD_STATEMENT_DATE", "ID_STATEMENT")
    opening, before = F.col("STD_OPENING_BALANCE").cast("double"), F.lag(F.col("STD_CLOSING_BALANCE").cast("double")).over(w)
    first = (F.row_number().over(w) == 1) | F.col("STD_ACCOUNT").isNull() | F.col("STD_ACCOUNT_NUMBER").isNull()
    return heads.select(F.col("STD_ACCOUNT").alias("account_type"), F.col("STD_ACCOUNT_NUMBER").alias("account_number"), F.col("STD_ACCOUNT_HOLDER").alias("account_holder"),
                        F.col("STD_STATEMENT_DATE").alias("statement_date"), opening.alias("opening_balance"), F.col("STD_CLOSING_BALANCE").cast("double").alias("closing_balance"),
                        F.when(first, "").when(opening == before, "").otherwise("GAP").alias("gap_flag"))


def dim_statement_batch(m: dict[str, DataFrame], batch_lines: DataFrame) -> DataFrame:
    """Statements once for each batch that processed them."""
    b = batch_lines.select(F.col("ID_BATCH").alias("batch_id"), F.col("ID_STATEMENT").alias("id_statement")).distinct()
    return b.join(m["DimStatement"].drop("id_batch", "currency"), "id_statement").select("batch_id", *[c for c in m["DimStatement"].columns if c not in ("id_batch", "currency")])


def fact_transaction_batch(m: dict[str, DataFrame], statements: DataFrame) -> DataFrame:
    """Transactions once for each batch of their statement."""
    return m["FactTransaction"].join(statements.select("batch_id", "statement_int"), "statement_int").select("batch_id", *m["FactTransaction"].columns)


def dim_account_batch(m: dict[str, DataFrame], statements: DataFrame) -> DataFrame:
    """Accounts of each batch."""
    pairs = statements.select("batch_id", "account_int").distinct()
    return pairs.join(m["DimAccount"].drop("currency"), "account_int").select("batch_id", *[c for c in m["DimAccount"].columns if c != "currency"])


def batch_ranges(m: dict[str, DataFrame], statements: DataFrame) -> DataFrame:
    """First transaction day and last statement day of each batch, over statements with transactions."""
    firsts = m["FactTransaction"].groupBy("statement_int").agg(F.min("id_date").alias("lo"))
    return statements.select("batch_id", "statement_int", "statement_date").join(firsts, "statement_int").groupBy("batch_id").agg(F.min("lo").alias("min_date"), F.max("statement_date").alias("max_date"))


def dim_date_batch(m: dict[str, DataFrame], ranges: DataFrame) -> DataFrame:
    """Calendar rows of each batch's range; the range is unfolded to days, so the join is on equal days."""
    days = ranges.where("min_date <= max_date").select("batch_id", F.explode(F.sequence("min_date", "max_date")).alias("id_date"))
    return m["DimDate"].join(days, "id_date").select(*m["DimDate"].columns, "batch_id")


def fact_balance_batch(m: dict[str, DataFrame], accounts: DataFrame, dates: DataFrame) -> DataFrame:
    """Balances of each batch's accounts on its days."""
    a, d = accounts.select("batch_id", "account_int"), dates.select("batch_id", "date_int")
    return m["FactBalance"].join(a, "account_int").join(d, ["batch_id", "date_int"]).select("batch_id", *m["FactBalance"].columns)


def flat_transaction_batch(facts: DataFrame, statements: DataFrame, accounts: DataFrame) -> DataFrame:
    """The wide rows of each batch."""
    s = statements.select("batch_id", "statement_int", "statement_date", "filename")
    a = accounts.select("batch_id", "account_int", "company", "account_type", "account_number", "sortcode", "account_holder")
    rows = facts.join(s, ["batch_id", "statement_int"]).join(a, ["batch_id", "account_int"])
    return rows.select("batch_id", F.col("id_date").alias("transaction_date"), "statement_date", "filename", *a.columns[2:], "transaction_number", F.col("transaction_credit_or_debit").alias("CD"),
                       F.col("transaction_type").alias("type"), "transaction_desc", F.substring("transaction_desc", 1, DESC_CHARS).alias("short_desc"), "value_in", "value_out", "value")


#: The views by name, each from the tables and views before it; raw tables are among the tables.
MAKERS = {
    "FlatTransaction": flat_transaction,
    "GapReport": lambda t: gap_report(t["statement_heads"]),
    "DimStatementBatch": lambda t: dim_statement_batch(t, t["batch_lines"]),
    "FactTransactionBatch": lambda t: fact_transaction_batch(t, t["DimStatementBatch"]),
    "DimAccountBatch": lambda t: dim_account_batch(t, t["DimStatementBatch"]),
    "DimDateBatch": lambda t: dim_date_batch(t, batch_ranges(t, t["DimStatementBatch"])),
    "FactBalanceBatch": lambda t: fact_balance_batch(t, t["DimAccountBatch"], t["DimDateBatch"]),
    "FlatTransactionBatch": lambda t: flat_transaction_batch(t["FactTransactionBatch"], t["DimStatementBatch"], t["DimAccountBatch"]),
}
#: The small views that other views read are kept as tables.
KEPT = ("DimStatementBatch", "DimAccountBatch", "DimDateBatch")


def build(m: Mapping[str, DataFrame], raw: Mapping[str, DataFrame], keeper: Keeper | None = None) -> Tables:
    """All eight views by name."""
    keeper = keeper or Keeper(raw["statement_heads"].sparkSession)
    makers = MAKERS | {n: lambda t, n=n: keeper(n, lambda: MAKERS[n](t)) for n in KEPT}
    known = {n: lambda _, n=n: raw[n] for n in raw}
    tables = m.with_more(known | makers) if isinstance(m, Tables) else Tables(known | {n: lambda t, df=df: df for n, df in m.items()} | makers)
    return Tables({n: lambda _, n=n: tables[n] for n in MAKERS})
