"""A ledger in the raw statement model, drawn from the order tables.

An account is a market segment of a nation (company: the nation, account type:
the segment), a transaction is an order (money out if its status is F), and a
statement is a year of an account.  The text below is plain SQL that Spark and
the SQL oracle both read, so both sides start from the same raw rows.

What the raw rows show on purpose: stated payments that don't match the lines
(every account of nations with a key of 3 more than a multiple of 7), opening
balances that don't follow the last closing balance (the same for 5), lines
without description (priority 4), statements processed again in a second batch
(segment BUILDING), and a last year whose batch has no head yet.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import SparkSession

from ledgerloom.plans.lazy import Tables

#: Raw tables in order of dependence (statements are at most one a year of an account, so the windows over them are short); ``{string}`` is the engine's text type.
RAW = {
    "ledger_base": """
SELECT o_orderkey, c_nationkey AS nk, n_name, c_mktsegment AS seg, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y,
       CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS DECIMAL(16,4)) AS pin,
       CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS DECIMAL(16,4)) AS pout,
       o_orderpriority AS kind
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "ledger_run": """
SELECT *, 'S' || lpad(CAST(nk AS {string}), 2, '0') || '-' || seg || '-' || CAST(y AS {string}) AS id_statement,
       row_number() OVER (PARTITION BY nk, seg, y ORDER BY d, o_orderkey) AS tn,
       CAST(sum(pin - pout) OVER (PARTITION BY nk, seg ORDER BY d, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(16,4)) AS running
FROM ledger_base""",
    "statement_lines": """
SELECT id_statement || '.' || CAST(tn AS {string}) AS ID_TRANSACTION, id_statement AS ID_STATEMENT, CAST(1 + (tn - 1) / 40 AS INT) AS STD_PAGE_NUMBER,
       d AS STD_TRANSACTION_DATE, CAST(tn AS BIGINT) AS STD_TRANSACTION_NUMBER, CASE WHEN pin > pout THEN 'C' ELSE 'D' END AS STD_CD,
       substring(kind, 3, 20) AS STD_TRANSACTION_TYPE, substring(kind, 1, 1) AS STD_TRANSACTION_TYPE_CD,
       CASE WHEN kind NOT LIKE '4%' THEN 'Order ' || CAST(o_orderkey AS {string}) || ' (' || kind || '), ' || seg END AS STD_TRANSACTION_DESC,
       CAST(running - (pin - pout) AS DECIMAL(16,4)) AS STD_OPENING_BALANCE, pin AS STD_TRANSACTION_PAYMENTS_IN, pout AS STD_TRANSACTION_PAYMENTS_OUT,
       running AS STD_CLOSING_BALANCE
FROM ledger_run""",
    "ledger_statements": """
SELECT id_statement, nk, n_name, seg, y, max(d) AS last_day, max_by(running, tn) AS closing, CAST(sum(pin) AS DECIMAL(16,4)) AS total_in, CAST(sum(pout) AS DECIMAL(16,4)) AS total_out
FROM ledger_run GROUP BY id_statement, nk, n_name, seg, y""",
    "batch_lines": """
SELECT 'B' || CAST(y AS {string}) AS ID_BATCH, 'B' || CAST(y AS {string}) || '_' || CAST(row_number() OVER (PARTITION BY y ORDER BY id_statement) AS {string}) AS ID_BATCHLINE,
       id_statement AS ID_STATEMENT, CAST(row_number() OVER (PARTITION BY y ORDER BY id_statement) AS BIGINT) AS STD_BATCH_LINE, id_statement || '.pdf' AS STD_FILENAME, seg AS STD_ACCOUNT,
       CAST(CAST(y AS {string}) || '-12-31 08:00:00' AS TIMESTAMP) AS STD_UPDATETIME FROM ledger_statements
UNION ALL
SELECT 'BX', 'BX_' || CAST(row_number() OVER (ORDER BY id_statement) AS {string}), id_statement, CAST(row_number() OVER (ORDER BY id_statement) AS BIGINT), id_statement || '-again.pdf', seg,
       CAST('2001-01-31 08:00:00' AS TIMESTAMP) FROM ledger_statements WHERE seg = 'BUILDING'""",
    "batch_heads": """
SELECT ID_BATCH, CAST(count(*) AS BIGINT) AS STD_PDF_COUNT FROM batch_lines
WHERE ID_BATCH = 'BX' OR ID_BATCH < (SELECT max(ID_BATCH) FROM batch_lines WHERE ID_BATCH <> 'BX') GROUP BY ID_BATCH""",
    "statement_heads": """
SELECT s.id_statement AS ID_STATEMENT, b.ID_BATCHLINE, n_name || '_' || seg || '_' || lpad(CAST(nk AS {string}), 8, '0') AS ID_ACCOUNT, n_name AS STD_COMPANY, 'ANNUAL' AS STD_STATEMENT_TYPE,
       seg AS STD_ACCOUNT, CASE nk % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' ELSE 'EUR' END AS STD_CURRENCY, '00-00-' || lpad(CAST(nk AS {string}), 2, '0') AS STD_SORTCODE,
       lpad(CAST(nk AS {string}), 8, '0') AS STD_ACCOUNT_NUMBER, 'Holder of ' || n_name AS STD_ACCOUNT_HOLDER, last_day AS STD_STATEMENT_DATE,
       CAST(closing - (total_in - total_out) + CASE WHEN nk % 7 = 5 THEN 5 ELSE 0 END AS DECIMAL(16,4)) AS STD_OPENING_BALANCE,
       CAST(total_in + CASE WHEN nk % 7 = 3 THEN 1 ELSE 0 END AS DECIMAL(16,4)) AS STD_PAYMENTS_IN, total_out AS STD_PAYMENTS_OUT, closing AS STD_CLOSING_BALANCE
FROM ledger_statements s JOIN batch_lines b ON b.ID_STATEMENT = s.id_statement AND b.ID_BATCH <> 'BX'""",
}


#: The raw tables that others are made of, or whose making shuffles, are kept; the rest are projections.
KEPT = ("ledger_run", "ledger_statements", "batch_lines", "batch_heads", "statement_heads")


def ledger(spark: SparkSession, sf_dir: str, keeper: Callable | None = None) -> Tables:
    """The raw tables by name, each made when first asked for; with a ``keeper`` those of ``KEPT`` are stored once and scanned."""
    base = ("orders", "customer", "nation")

    def maker(name: str, text: str):
        text = text.replace("{string}", "STRING").replace("(tn - 1) / 40", "(tn - 1) DIV 40")
        names = re.compile(rf"(?<=FROM |JOIN )({'|'.join([*base, *RAW])})\b")
        used, text = set(names.findall(text)), names.sub(r"{\1}", text)
        plan = lambda t: spark.sql(text, **{u: t[u] for u in used})
        return (lambda t: keeper(name, lambda: plan(t))) if keeper and name in KEPT else plan

    sources = {t: lambda _, t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in base}
    return Tables(sources | {name: maker(name, text) for name, text in RAW.items()})


def prelude() -> str:
    """The raw tables as SQL common table expressions of the oracle."""
    return ",\n".join(f"{name} AS ({text.replace('{string}', 'VARCHAR').replace('(tn - 1) / 40', '(tn - 1) // 40')})" for name, text in RAW.items())
