"""The mart and its views in the oracle's SQL, after the raw tables."""

from __future__ import annotations

from ledgerloom.sources.adapters import prelude

MART = {
    "dim_date": """
SELECT CAST(row_number() OVER (ORDER BY d) AS BIGINT) AS date_int, d AS id_date, strftime(d, '%d/%m/%Y') AS date_local_format, CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_integer,
       CAST(year(d) AS BIGINT) AS year, CAST(year(d) % 100 AS BIGINT) AS year_short, CAST(month(d) AS BIGINT) AS quarter, 'Q' || month(d) AS quarter_name, CAST(month(d) AS BIGINT) AS month_number,
       strftime(d, '%m') AS month_number_padded, strftime(d, '%B') AS month_name, strftime(d, '%b') AS month_abbrv, CAST(strftime(d, '%Y%m') AS BIGINT) AS period, CAST(strftime(d, '%W') AS BIGINT) AS week,
       CAST(strftime(d, '%Y%W') AS BIGINT) AS year_week, CAST(day(d) AS BIGINT) AS day_of_month, CAST(dayofyear(d) AS BIGINT) AS day_of_year, CAST(dayofweek(d) + 1 AS BIGINT) AS day_of_week,
       strftime(d, '%A') AS weekday, strftime(d, '%a') AS weekday_abbrv, substr(strftime(d, '%A'), 1, 1) AS weekday_initial, CAST(d = last_day(d) AS BIGINT) AS is_last_day_of_month,
       CAST(d = last_day(d) AND month(d) % 3 = 0 AS BIGINT) AS is_last_day_of_quarter, CAST(d = last_day(d) AND month(d) = 12 AS BIGINT) AS is_last_day_of_year, CAST(dayofweek(d) NOT IN (0, 6) AS BIGINT) AS is_weekday
FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
      FROM (SELECT min(STD_TRANSACTION_DATE) AS lo, max(STD_STATEMENT_DATE) AS hi FROM statement_heads JOIN statement_lines USING (ID_STATEMENT)))""",
    "dim_account": """
SELECT CAST(row_number() OVER (ORDER BY ID_ACCOUNT) AS BIGINT) AS account_int, ID_ACCOUNT AS id_account, STD_COMPANY AS company, STD_ACCOUNT AS account_type, STD_ACCOUNT_NUMBER AS account_number,
       STD_SORTCODE AS sortcode, STD_ACCOUNT_HOLDER AS account_holder, STD_CURRENCY AS currency
FROM (SELECT *, row_number() OVER (PARTITION BY ID_ACCOUNT ORDER BY STD_STATEMENT_DATE DESC, ID_STATEMENT DESC) AS rn FROM statement_heads WHERE ID_ACCOUNT IS NOT NULL) WHERE rn = 1""",
    "dim_statement": """
SELECT CAST(row_number() OVER (ORDER BY h.ID_STATEMENT) AS BIGINT) AS statement_int, h.ID_STATEMENT AS id_statement, a.account_int, a.id_account, b.ID_BATCH AS id_batch, STD_COMPANY AS company,
       h.STD_ACCOUNT AS account_type, STD_ACCOUNT_NUMBER AS account_number, STD_SORTCODE AS sortcode, STD_ACCOUNT_HOLDER AS account_holder, STD_STATEMENT_DATE AS statement_date,
       CAST(STD_OPENING_BALANCE AS DOUBLE) AS opening_balance, CAST(STD_PAYMENTS_IN AS DOUBLE) AS payments_in, CAST(STD_PAYMENTS_OUT AS DOUBLE) AS payments_out, CAST(STD_CLOSING_BALANCE AS DOUBLE) AS closing_balance,
       STD_STATEMENT_TYPE AS statement_type, STD_CURRENCY AS currency, STD_FILENAME AS filename, STD_UPDATETIME AS batch_time
FROM statement_heads h JOIN batch_lines b ON h.ID_BATCHLINE = b.ID_BATCHLINE JOIN dim_account a ON a.id_account = h.ID_ACCOUNT""",
    "fact_transaction": """
SELECT CAST(row_number() OVER (ORDER BY ID_TRANSACTION) AS BIGINT) AS transaction_int, ID_TRANSACTION AS id_transaction, s.statement_int, s.account_int, d.date_int, d.id_date, s.id_account, s.id_statement,
       STD_TRANSACTION_NUMBER AS transaction_number, STD_CD AS transaction_credit_or_debit, STD_TRANSACTION_TYPE AS transaction_type, STD_TRANSACTION_TYPE_CD AS transaction_type_cd,
       STD_TRANSACTION_DESC AS transaction_desc, CAST(STD_OPENING_BALANCE AS DOUBLE) AS opening_balance, CAST(STD_TRANSACTION_PAYMENTS_IN AS DOUBLE) AS value_in,
       CAST(STD_TRANSACTION_PAYMENTS_OUT AS DOUBLE) AS value_out, CAST(STD_TRANSACTION_PAYMENTS_IN AS DOUBLE) - CAST(STD_TRANSACTION_PAYMENTS_OUT AS DOUBLE) AS value
FROM statement_lines l JOIN dim_statement s ON l.ID_STATEMENT = s.id_statement JOIN dim_date d ON l.STD_TRANSACTION_DATE = d.id_date""",
    "daily": """
SELECT account_int, date_int, CAST(max(STD_CLOSING_BALANCE) AS DOUBLE) AS closing_balance, CAST(sum(STD_TRANSACTION_PAYMENTS_IN - STD_TRANSACTION_PAYMENTS_OUT) AS DOUBLE) AS movement
FROM fact_transaction f JOIN statement_lines l ON f.id_transaction = l.ID_TRANSACTION GROUP BY account_int, date_int""",
    "bookends": "SELECT account_int, min(date_int) AS first_did, max(date_int) AS last_did FROM daily GROUP BY account_int",
    "grid": """
SELECT d.date_int, a.account_int, d.id_date, a.id_account, d.date_int < b.first_did AS pre, d.date_int > b.last_did AS post, g.closing_balance, coalesce(g.movement, 0.0) AS movement,
       count(g.closing_balance) OVER (PARTITION BY a.account_int ORDER BY d.date_int) AS fwd, count(g.closing_balance) OVER (PARTITION BY a.account_int ORDER BY d.date_int DESC) AS bwd
FROM dim_date d CROSS JOIN dim_account a LEFT JOIN bookends b ON b.account_int = a.account_int LEFT JOIN daily g ON g.account_int = a.account_int AND g.date_int = d.date_int""",
    "fact_balance": """
SELECT date_int, account_int, id_date, id_account, CASE WHEN coalesce(pre, FALSE) THEN NULL ELSE max(closing_balance) OVER (PARTITION BY account_int, bwd) END AS opening_balance,
       CASE WHEN coalesce(pre, FALSE) THEN NULL ELSE max(closing_balance) OVER (PARTITION BY account_int, fwd) END AS closing_balance, CAST(movement AS DOUBLE) AS movement,
       CAST(coalesce(pre OR post, FALSE) AS BIGINT) AS outside_date FROM grid""",
    "flat_transaction": """
SELECT f.id_date AS transaction_date, s.statement_date, s.filename, a.company, a.account_type, a.account_number, a.sortcode, a.account_holder, transaction_number, transaction_credit_or_debit AS CD,
       transaction_type AS type, transaction_desc, substr(transaction_desc, 1, 25) AS short_desc, value_in, value_out, value
FROM fact_transaction f JOIN dim_statement s USING (statement_int) JOIN dim_account a ON a.account_int = f.account_int""",
    "gap_report": """
SELECT STD_ACCOUNT AS account_type, STD_ACCOUNT_NUMBER AS account_number, STD_ACCOUNT_HOLDER AS account_holder, STD_STATEMENT_DATE AS statement_date, CAST(STD_OPENING_BALANCE AS DOUBLE) AS opening_balance,
       CAST(STD_CLOSING_BALANCE AS DOUBLE) AS closing_balance,
       CASE WHEN lag(ID_STATEMENT) OVER w IS NULL THEN '' WHEN CAST(STD_OPENING_BALANCE AS DOUBLE) = lag(CAST(STD_CLOSING_BALANCE AS DOUBLE)) OVER w THEN '' ELSE 'GAP' END AS gap_flag
FROM statement_heads WINDOW w AS (PARTITION BY STD_ACCOUNT, STD_ACCOUNT_NUMBER ORDER BY STD_STATEMENT_DATE, ID_STATEMENT)""",
    "dim_statement_batch": """
SELECT DISTINCT b.ID_BATCH AS batch_id, s.* EXCLUDE (id_batch, currency) FROM dim_statement s JOIN batch_lines b ON s.id_statement = b.ID_STATEMENT""",
    "fact_transaction_batch": "SELECT s.batch_id, f.* FROM fact_transaction f JOIN dim_statement_batch s ON f.statement_int = s.statement_int",
    "dim_account_batch": "SELECT DISTINCT s.batch_id, a.* EXCLUDE (currency) FROM dim_account a JOIN dim_statement_batch s ON a.account_int = s.account_int",
    "batch_ranges": """
SELECT f.batch_id, min(f.id_date) AS min_date, max(s.statement_date) AS max_date FROM fact_transaction_batch f JOIN dim_statement_batch s ON f.statement_int = s.statement_int AND f.batch_id = s.batch_id GROUP BY f.batch_id""",
    "dim_date_batch": "SELECT d.*, r.batch_id FROM dim_date d JOIN batch_ranges r ON d.id_date BETWEEN r.min_date AND r.max_date",
    "fact_balance_batch": """
SELECT a.batch_id, f.* FROM fact_balance f JOIN dim_account_batch a ON f.account_int = a.account_int JOIN dim_date_batch d ON f.date_int = d.date_int AND a.batch_id = d.batch_id""",
    "flat_transaction_batch": """
SELECT f.batch_id, f.id_date AS transaction_date, s.statement_date, s.filename, a.company, a.account_type, a.account_number, a.sortcode, a.account_holder, f.transaction_number, f.transaction_credit_or_debit AS CD,
       f.transaction_type AS type, f.transaction_desc, substr(f.transaction_desc, 1, 25) AS short_desc, f.value_in, f.value_out, f.value
FROM fact_transaction_batch f JOIN dim_statement_batch s ON f.statement_int = s.statement_int AND f.batch_id = s.batch_id
JOIN dim_account_batch a ON f.account_int = a.account_int AND f.batch_id = a.batch_id""",
}


def over_ledger(select: str, **more: str) -> str:
    """A SELECT that may name any raw table, any table of MART and those given."""
    tables = [prelude(), *(f"{n} AS ({t})" for n, t in MART.items()), *(f"{n} AS ({t})" for n, t in more.items())]
    return "WITH " + ",\n".join(tables) + "\n" + select
