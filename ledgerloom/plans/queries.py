"""The registered queries of the ledger operators, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import fields, standard
from ledgerloom.functions.fields import Field, Modifier
from ledgerloom.operators import checks, keyed, transactions
from ledgerloom.operators.identify import Probe, identify, locations, search
from ledgerloom.operators.transactions import Bookend, Rule
from ledgerloom.plans import export, fx, mart, reports, store, views
from ledgerloom.plans.kept import Keeper, stamp
from ledgerloom.plans.lazy import Tables
from ledgerloom.plans.oracles import over_ledger
from ledgerloom.sources import adapters, grids

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL if there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def of_mart(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir)[1][name]


for key, name in (("dim_date", "DimDate"), ("dim_account", "DimAccount"), ("dim_statement", "DimStatement"), ("fact_transaction", "FactTransaction"), ("fact_balance", "FactBalance"),
                  ("flat_transaction", "FlatTransaction"), ("gap_report", "GapReport"), ("dim_statement_batch", "DimStatementBatch"), ("fact_transaction_batch", "FactTransactionBatch"),
                  ("dim_account_batch", "DimAccountBatch"), ("dim_date_batch", "DimDateBatch"), ("fact_balance_batch", "FactBalanceBatch"), ("flat_transaction_batch", "FlatTransactionBatch")):
    QUERIES[key] = partial(of_mart, name)
    ORACLES[key] = over_ledger(f"SELECT * FROM {key}")


def keeper_of(spark: SparkSession, sf_dir: str) -> Keeper:
    """Where the ledger of these order tables is kept; other files or newer ones have another place."""
    return Keeper(spark, stamp(spark, [f"{sf_dir}/{t}.parquet" for t in ("orders", "customer", "nation")]))


def ledger(spark: SparkSession, sf_dir: str) -> Tables:
    return adapters.ledger(spark, sf_dir, keeper_of(spark, sf_dir))


def parts(spark: SparkSession, sf_dir: str) -> tuple[Tables, Tables]:
    """Raw tables, and the mart with its views."""
    keeper = keeper_of(spark, sf_dir)
    raw = adapters.ledger(spark, sf_dir, keeper)
    m = mart.build(raw, keeper)
    v = views.build(m, raw, keeper)
    return raw, m.with_more({n: lambda _, n=n: v[n] for n in v})


# Steps of the mart as queries of their own


@query(over_ledger("SELECT min(STD_TRANSACTION_DATE) AS lo, max(STD_STATEMENT_DATE) AS hi FROM statement_heads JOIN statement_lines USING (ID_STATEMENT)"))
def date_range(spark, sf_dir):
    raw = ledger(spark, sf_dir)
    return mart.date_range(raw["statement_heads"], raw["statement_lines"])


@query(over_ledger("SELECT * FROM daily"))
def daily_balance(spark, sf_dir):
    return parts(spark, sf_dir)[1]["daily"]


@query(over_ledger("SELECT * FROM bookends"))
def account_bookends(spark, sf_dir):
    return mart.bookends(parts(spark, sf_dir)[1]["daily"])


@query(over_ledger("SELECT * FROM batch_ranges"))
def batch_ranges(spark, sf_dir):
    _, m = parts(spark, sf_dir)
    return views.batch_ranges(m, m["DimStatementBatch"])


@query(over_ledger("SELECT date_int, account_int, CAST(fwd AS BIGINT) AS fwd_group, CAST(bwd AS BIGINT) AS bwd_group FROM grid"))
def fill_groups(spark, sf_dir):
    _, m = parts(spark, sf_dir)
    known = m["daily"].select("account_int", "date_int", F.lit(1).alias("k"))
    cells = m["FactBalance"].select("account_int", "date_int").join(known, ["account_int", "date_int"], "left")
    w = Window.partitionBy("account_int")
    up, down = w.orderBy("date_int"), w.orderBy(F.desc("date_int"))
    return cells.select("date_int", "account_int", F.count("k").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("fwd_group"), F.count("k").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("bwd_group"))


@query(over_ledger(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {t}" for n, t in
                                      (("DimDate", "dim_date"), ("DimAccount", "dim_account"), ("DimStatement", "dim_statement"), ("FactTransaction", "fact_transaction"), ("FactBalance", "fact_balance")))))
def mart_counts(spark, sf_dir):
    return reports.counts(mart.build(ledger(spark, sf_dir), keeper_of(spark, sf_dir)))


@query(over_ledger("SELECT * FROM gap_report WHERE gap_flag = 'GAP'"))
def gaps_only(spark, sf_dir):
    return reports.gaps(parts(spark, sf_dir)[1]["GapReport"])


@query(over_ledger("SELECT * FROM flat_transaction_batch WHERE batch_id = 'BX'"))
def report_of_batch(spark, sf_dir):
    reports.register({"FlatTransactionBatch": parts(spark, sf_dir)[1]["FlatTransactionBatch"]})
    return reports.scan(spark, "FlatTransaction", "BX")


@query(over_ledger("SELECT * FROM dim_statement"))
def report_scan(spark, sf_dir):
    reports.register({"DimStatement": parts(spark, sf_dir)[1]["DimStatement"]})
    return reports.scan(spark, "DimStatement")


@query(over_ledger(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {t}" for n, t in
                                      (("DimDate", "dim_date"), ("DimAccount", "dim_account"), ("DimStatement", "dim_statement"), ("FactTransaction", "fact_transaction"), ("FactBalance", "fact_balance"), ("GapReport", "gap_report")))))
def report_multi(spark, sf_dir):
    reports.register(parts(spark, sf_dir)[1])
    return reports.counts(reports.collection(spark, "multi"))


# Checks and balances

CAB = """
SELECT h.ID_STATEMENT, STD_OPENING_BALANCE, STD_PAYMENTS_IN, STD_PAYMENTS_OUT, STD_CLOSING_BALANCE, t_in, t_out, t_move, running, n, n_date, n_desc,
       coalesce(STD_PAYMENTS_IN = t_in, FALSE) AS bal_in, coalesce(STD_PAYMENTS_OUT = t_out, FALSE) AS bal_out,
       coalesce(STD_CLOSING_BALANCE - STD_OPENING_BALANCE = t_move AND t_move = STD_PAYMENTS_IN - STD_PAYMENTS_OUT, FALSE) AS bal_move,
       coalesce(STD_CLOSING_BALANCE = running OR STD_PAYMENTS_IN + STD_PAYMENTS_OUT + t_in + t_out = 0, FALSE) AS bal_close, coalesce(STD_PAYMENTS_IN + STD_PAYMENTS_OUT + t_in + t_out = 0, FALSE) AS zero
FROM statement_heads h LEFT JOIN (
  SELECT l.ID_STATEMENT, sum(STD_TRANSACTION_PAYMENTS_IN) AS t_in, sum(STD_TRANSACTION_PAYMENTS_OUT) AS t_out, sum(STD_TRANSACTION_PAYMENTS_IN - STD_TRANSACTION_PAYMENTS_OUT) AS t_move,
         any_value(o) + sum(STD_TRANSACTION_PAYMENTS_IN - STD_TRANSACTION_PAYMENTS_OUT) AS running, count(*) AS n, count(*) FILTER (STD_TRANSACTION_DATE IS NULL) AS n_date, count(*) FILTER (STD_TRANSACTION_DESC IS NULL) AS n_desc
  FROM statement_lines l JOIN (SELECT ID_STATEMENT, STD_OPENING_BALANCE AS o FROM statement_heads) s ON s.ID_STATEMENT = l.ID_STATEMENT GROUP BY l.ID_STATEMENT) t ON t.ID_STATEMENT = h.ID_STATEMENT"""
VERDICT = "(zero OR (n > 0 AND bal_in AND bal_out AND bal_move AND bal_close AND n_date = 0 AND n_desc = 0))"


def cab_of(raw: dict[str, DataFrame]) -> DataFrame:
    lines = standard.line_columns(raw["statement_lines"], raw["statement_heads"], "ID_STATEMENT", ["STD_TRANSACTION_NUMBER"])
    return checks.balance(raw["statement_heads"], lines)


@query(over_ledger(f"""SELECT ID_STATEMENT, bal_in AS BAL_PAYMENTS_IN, bal_out AS BAL_PAYMENTS_OUT, bal_move AS BAL_MOVEMENT, bal_close AS BAL_CLOSING, zero AS ZERO_TRANSACTION_STATEMENT,
  coalesce(n, 0) AS TRANSACTION_LINE_COUNT, coalesce(n_date, 0) AS TRANSACTION_LINES_WITH_NULL_DATE, coalesce(n_desc, 0) AS TRANSACTION_LINES_WITH_NULL_DESC,
  CAST(t_in AS DOUBLE) AS STD_TRANSACTION_PAYMENTS_IN, CAST(t_out AS DOUBLE) AS STD_TRANSACTION_PAYMENTS_OUT, CAST(t_move AS DOUBLE) AS STD_TRANSACTION_MOVEMENT, CAST(running AS DOUBLE) AS STD_RUNNING_BALANCE,
  CAST(STD_CLOSING_BALANCE - STD_OPENING_BALANCE AS DOUBLE) AS STD_MOVEMENT, CAST(STD_PAYMENTS_IN - STD_PAYMENTS_OUT AS DOUBLE) AS STD_BALANCE_OF_PAYMENTS, {VERDICT} AS SUCCESS FROM cab""", cab=CAB))
def checks_and_balances(spark, sf_dir):
    cab = cab_of(ledger(spark, sf_dir))
    money = ("STD_TRANSACTION_PAYMENTS_IN", "STD_TRANSACTION_PAYMENTS_OUT", "STD_TRANSACTION_MOVEMENT", "STD_RUNNING_BALANCE", "STD_MOVEMENT", "STD_BALANCE_OF_PAYMENTS")
    flags = [c for c in cab.columns if c.startswith(("BAL_", "ZERO", "TRANSACTION_"))]
    return cab.select("ID_STATEMENT", *flags, *(F.col(c).cast("double").alias(c) for c in money), "SUCCESS")


@query(over_ledger("""SELECT ID_STATEMENT, concat_ws(' | ',
  CASE WHEN n_date > 0 THEN 'NULL_DATES lines=' || n || ' with_null_date=' || n_date END, CASE WHEN n_desc > 0 THEN 'NULL_DESCRIPTIONS lines=' || n || ' with_null_description=' || n_desc END,
  CASE WHEN NOT bal_in THEN 'BAL_PAYMENTS_IN stated=' || STD_PAYMENTS_IN || ' extracted=' || CAST(t_in AS DECIMAL(16,4)) || ' delta=' || CAST(round(STD_PAYMENTS_IN - t_in, 2) AS DECIMAL(16,2)) END,
  CASE WHEN NOT bal_out THEN 'BAL_PAYMENTS_OUT stated=' || STD_PAYMENTS_OUT || ' extracted=' || CAST(t_out AS DECIMAL(16,4)) || ' delta=' || CAST(round(STD_PAYMENTS_OUT - t_out, 2) AS DECIMAL(16,2)) END,
  CASE WHEN NOT bal_move THEN 'BAL_MOVEMENT movement=' || CAST(STD_CLOSING_BALANCE - STD_OPENING_BALANCE AS DECIMAL(16,4)) || ' transaction_movement=' || CAST(t_move AS DECIMAL(16,4)) || ' balance_of_payments=' || CAST(STD_PAYMENTS_IN - STD_PAYMENTS_OUT AS DECIMAL(16,4)) END,
  CASE WHEN NOT bal_close THEN 'BAL_CLOSING stated=' || STD_CLOSING_BALANCE || ' calculated=' || CAST(running AS DECIMAL(16,4)) || ' delta=' || CAST(round(STD_CLOSING_BALANCE - running, 2) AS DECIMAL(16,2)) END) AS detail FROM cab""", cab=CAB))
def check_details(spark, sf_dir):
    return checks.detail(cab_of(ledger(spark, sf_dir))).select("ID_STATEMENT", "detail")


@query(over_ledger("""SELECT b.ID_BATCHLINE AS ID_CAB, b.ID_BATCHLINE, b.ID_BATCH, NOT zero AS HAS_TRANSACTIONS, bal_in AS CHECK_PAYMENTS_IN, bal_out AS CHECK_PAYMENTS_OUT, bal_move AS CHECK_MOVEMENT, bal_close AS CHECK_CLOSING,
  CAST(STD_OPENING_BALANCE AS DOUBLE) AS STD_OPENING_BALANCE_HEADS, CAST(running - t_move AS DOUBLE) AS STD_OPENING_BALANCE_LINES, CAST(running AS DOUBLE) AS STD_CLOSING_BALANCE_LINES, n AS TRANSACTION_LINE_COUNT
  FROM cab JOIN batch_lines b USING (ID_STATEMENT)""", cab=CAB))
def check_records(spark, sf_dir):
    raw = ledger(spark, sf_dir)
    rows = checks.record(cab_of(raw), raw["batch_lines"])
    money = ("STD_OPENING_BALANCE_HEADS", "STD_OPENING_BALANCE_LINES", "STD_CLOSING_BALANCE_LINES")
    return rows.select("ID_CAB", "ID_BATCHLINE", "ID_BATCH", "HAS_TRANSACTIONS", *[c for c in rows.columns if c.startswith("CHECK_")], *(F.col(c).cast("double").alias(c) for c in money), "TRANSACTION_LINE_COUNT")


ROUTES = f"""SELECT b.ID_BATCH, b.ID_BATCHLINE, CASE WHEN b.STD_BATCH_LINE % 50 = 0 THEN 'FAILURE CONFIG' WHEN {VERDICT} THEN 'SUCCESS' ELSE 'REVIEW CAB' END AS outcome FROM cab JOIN batch_lines b USING (ID_STATEMENT)"""


def routed(spark, sf_dir) -> DataFrame:
    """Outcomes of the batch lines; every fiftieth of a batch stands for one whose configuration failed."""
    raw = ledger(spark, sf_dir)
    rows = cab_of(raw).select("ID_STATEMENT", "SUCCESS").join(raw["batch_lines"], "ID_STATEMENT")
    broken = F.col("STD_BATCH_LINE") % 50 == 0
    flags = {"error_config": broken, "error_cab": ~F.col("SUCCESS") & ~broken, "error_data": F.lit(False), "error_other": F.lit(False)}
    return checks.outcome(rows.withColumns(flags))


@query(over_ledger("SELECT *, split_part(outcome, ' ', 1) AS result FROM routes", cab=CAB, routes=ROUTES))
def outcomes(spark, sf_dir):
    return routed(spark, sf_dir).select("ID_BATCH", "ID_BATCHLINE", "outcome", "result")


@query(over_ledger("""SELECT ID_BATCH, count(*) AS pdf_count, count(*) FILTER (outcome LIKE 'FAILURE%') AS errors, count(*) FILTER (outcome LIKE 'REVIEW%') AS reviews, count(*) FILTER (outcome = 'SUCCESS') AS successes
  FROM routes GROUP BY ID_BATCH""", cab=CAB, routes=ROUTES))
def outcome_tallies(spark, sf_dir):
    return checks.tallies(routed(spark, sf_dir), "ID_BATCH")


@query(over_ledger("""SELECT ID_TRANSACTION, CAST(m AS DOUBLE) AS STD_TRANSACTION_MOVEMENT, CASE WHEN m > 0 THEN 'C' ELSE 'D' END AS STD_CD,
  CAST(o + sum(m) OVER (PARTITION BY ID_STATEMENT ORDER BY STD_TRANSACTION_NUMBER ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS STD_RUNNING_BALANCE
  FROM (SELECT l.*, l.STD_TRANSACTION_PAYMENTS_IN - l.STD_TRANSACTION_PAYMENTS_OUT AS m, h.STD_OPENING_BALANCE AS o FROM statement_lines l JOIN statement_heads h USING (ID_STATEMENT))"""))
def running_balance(spark, sf_dir):
    raw = ledger(spark, sf_dir)
    rows = standard.line_columns(raw["statement_lines"], raw["statement_heads"], "ID_STATEMENT", ["STD_TRANSACTION_NUMBER"])
    return rows.select("ID_TRANSACTION", F.col("STD_TRANSACTION_MOVEMENT").cast("double").alias("STD_TRANSACTION_MOVEMENT"), "STD_CD", F.col("STD_RUNNING_BALANCE").cast("double").alias("STD_RUNNING_BALANCE"))


# The field language, over texts made of order rows


def amounts(spark, sf_dir) -> DataFrame:
    """Orders as a grid of amount text (with a D where money goes out), priority and clerk's note."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole = F.regexp_replace(F.floor(cents / 100).cast("long").cast("string"), r"(?<=\d)(?=(\d{3})+$)", ",")
    text = F.concat(F.lit("£"), whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.when(F.col("o_orderstatus") == "F", "D").when(F.col("o_orderstatus") == "P", " CR").otherwise(""))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("o_orderkey").alias("row"), F.array(text, F.col("o_orderpriority"), F.concat(F.lit("  ["), F.col("o_orderstatus"), F.lit("] "))).alias("cells"))


AMOUNT_SQL = """SELECT o_orderkey AS doc_id, '£' || regexp_replace(reverse(regexp_replace(reverse(CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS VARCHAR)), '(\\d{3})', '\\1,', 'g')), '^,', '') || '.' ||
  lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') || CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'P' THEN ' CR' ELSE '' END AS raw, o_orderpriority, o_orderstatus FROM orders"""
AMOUNT = Field("amount", "currency", 0, vital=True, currency="GBP", modifier=Modifier(suffix="D", multiplier=-1.0))


@query(f"""WITH a AS ({AMOUNT_SQL}), s AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace(raw, 'GBP', ''), '£', ''), ',', ''), ' ', ''), '\\s', '', 'g'), '\\.+$', '') AS st FROM a),
p AS (SELECT *, regexp_extract(st, '^\\d+[.]\\d{{2}}\\s?(D)?$', 0) AS pt FROM s),
c AS (SELECT *, CASE WHEN pt LIKE '%D' THEN TRY_CAST(rtrim(pt, 'D') AS DOUBLE) * -1 ELSE TRY_CAST(pt AS DOUBLE) END AS v FROM p)
SELECT doc_id, CAST(TRY_CAST(v AS DECIMAL(16,4)) AS DOUBLE) AS amount, v IS NOT NULL AS success, CASE WHEN pt = '' THEN 'pattern error' END AS error, v IS NULL AS hard_fail, st AS value_strip FROM c""")
def field_amount(spark, sf_dir):
    rows = fields.records(fields.read(amounts(spark, sf_dir).withColumn("value_raw", F.get("cells", F.lit(0))), AMOUNT), ["doc_id"])
    return rows.select("doc_id", F.col("value").cast("double").alias("amount"), "success", "error", "hard_fail", "value_strip")


@query(r"""SELECT o_orderkey AS doc_id, left(nullif(regexp_extract(ltrim(o_orderpriority, '12345-'), '^[A-Z]+', 0), ''), 4) AS value, regexp_extract(ltrim(o_orderpriority, '12345-'), '^[A-Z]+', 0) <> '' AS success FROM orders""")
def field_text(spark, sf_dir):
    f = Field("priority", column=1, strip_start="12345-", pattern="^[A-Z]+", max_length=4)
    return fields.records(fields.read(amounts(spark, sf_dir).withColumn("value_raw", F.get("cells", F.lit(1))), f), ["doc_id"]).select("doc_id", "value", "success")


@query(r"""WITH s AS (SELECT o_orderkey AS doc_id, o_orderstatus AS st, o_orderpriority AS p FROM orders)
SELECT doc_id, 'status' AS field, st AS value, TRUE AS success FROM s
UNION ALL SELECT doc_id, 'grade', CASE WHEN TRY_CAST(substr(p, 1, 1) AS INT) > 2 THEN NULL ELSE substr(p, 1, 1) END, TRY_CAST(substr(p, 1, 1) AS INT) <= 2 FROM s""")
def column_records(spark, sf_dir):
    grid = amounts(spark, sf_dir)
    rows = fields.from_column(grid, [Field("status", column=2, strip_start=" [", strip_end=" ]"), Field("grade", column=1, pattern="^[12]")], ["doc_id"])
    return rows.select("doc_id", "field", "value", "success")


@query(r"""SELECT o_orderkey AS doc_id, 'grade' AS field, o_orderstatus AS value, o_orderpriority AS value_raw FROM orders WHERE regexp_matches(o_orderpriority, '^[12]')""")
def value_offset(spark, sf_dir):
    f = Field("grade", column=1, pattern="^[12]", offset=fields.Offset(1, Field("status", strip_start=" [", strip_end=" ]")))
    return fields.from_column(amounts(spark, sf_dir), [f], ["doc_id"]).select("doc_id", "field", "value", "value_raw")


@query(r"""SELECT o_orderkey AS doc_id, 'pattern error' AS error FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[12]')""")
def scope_failures(spark, sf_dir):
    rows = fields.read(amounts(spark, sf_dir).withColumn("value_raw", F.get("cells", F.lit(1))), Field("grade", column=1, pattern="^[12]", vital=True))
    return fields.scoped(fields.records(rows, ["doc_id"]), "hard_fail").select("doc_id", "error")


@query(r"SELECT page_id AS doc_id, nullif(regexp_extract(html, '<title>[^<]+', 0), '') AS found FROM pages")
def region_search(spark, sf_dir):
    return search(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html"), "html", "<title>[^<]+", "found").drop("html")


@query(r"""SELECT doc_id, CAST(ord - 1 AS BIGINT) AS row, split_part(line, ' ', 1) AS first_word FROM (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS ord FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: trim(t) <> '') AS ls FROM documents)) WHERE ord > 1""")
def header_strip(spark, sf_dir):
    paged = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    rows = grids.strip_header(grids.grid(paged, " "), always=True)
    return rows.select("doc_id", F.col("row").cast("long").alias("row"), F.get("cells", F.lit(0)).alias("first_word"))


@query("""WITH p AS (SELECT conv_id AS doc_id, CAST(max(turn) AS INT) AS n FROM conversations GROUP BY conv_id), f AS (SELECT doc_id, 'total' AS location, n AS page FROM p WHERE n > 1)
SELECT * FROM f UNION ALL SELECT doc_id, 'lines', CAST(page AS INT) FROM (SELECT doc_id, n, unnest(range(1, n)) AS page FROM p) q WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = q.doc_id AND f.page = q.page)""")
def location_expansion(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.max("turn").cast("int").alias("n_pages"))
    spots = pages.where("n_pages > 1").select("doc_id", F.lit("total").alias("location"), F.col("n_pages").alias("page")).unionByName(pages.select("doc_id", F.lit("lines").alias("location"), F.lit(None).cast("int").alias("page")))
    return locations(pages, spots, exclude_last=1)


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https://blog\.') THEN 'BLOG' WHEN regexp_matches(url, '/(de|fr|es)/') THEN 'ABROAD' WHEN regexp_matches(url, '\.html$') THEN 'STATIC' END AS config FROM pages""")
def identification(spark, sf_dir):
    probes = [Probe("BLOG", r"^https://blog\."), Probe("ABROAD", "/(de|fr|es)/"), Probe("STATIC", r"\.html$")]
    return identify(table(spark, sf_dir, "pages"), "url", probes).select("page_id", "config")


@query()
def statement_ids(spark, sf_dir):
    return standard.ids(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("first_page"))).select("doc_id", "ID_STATEMENT")


# Transactions over several rows: conversations as statements


def turns(spark, sf_dir) -> DataFrame:
    """Turns as field records: the user's text, the answer and a note, by the role that speaks."""
    c = table(spark, sf_dir, "conversations")
    v = F.nullif("text", F.lit(""))
    return c.select("conv_id", F.lit(1).alias("page"), F.col("turn").alias("row"), F.when(F.col("role") == "user", "ask").when(F.col("role") == "assistant", "answer").otherwise("note").alias("field"), v.alias("value"), v.isNotNull().alias("success"))


STITCH_SQL = r"""WITH r AS (SELECT conv_id, turn AS row, CASE role WHEN 'user' THEN 'ask' WHEN 'assistant' THEN 'answer' ELSE 'note' END AS field, nullif(text, '') AS value FROM conversations),
k AS (SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.conv_id = a.conv_id AND b.row = a.row AND b.field = 'note' AND regexp_matches(b.value, '^The'))),
f AS (SELECT conv_id, row, max(CASE WHEN field = 'ask' THEN value END) AS ask, max(CASE WHEN field = 'answer' THEN value END) AS answer, max(CASE WHEN field = 'note' THEN value END) AS note,
             bool_or(field = 'ask' AND value IS NOT NULL) AS s, bool_or(field = 'answer' AND value IS NOT NULL) AS e FROM k GROUP BY conv_id, row),
n AS (SELECT *, CAST(sum(CAST(s AS INT)) OVER (PARTITION BY conv_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS transaction_number FROM f),
d AS (SELECT * EXCLUDE (ask, answer), last_value(ask IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ask, answer FROM n WHERE transaction_number > 0),
m AS (SELECT * EXCLUDE (answer), coalesce(string_agg(answer, ' / ' ORDER BY row) OVER (PARTITION BY conv_id, transaction_number ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '') AS answer FROM d)
"""


@query(STITCH_SQL.replace("string_agg(answer, ' / ' ORDER BY row) OVER (PARTITION BY conv_id, transaction_number ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "string_agg(answer, ' / ' ORDER BY row) OVER (PARTITION BY conv_id, transaction_number)")
       + "SELECT conv_id, CAST(row AS BIGINT) AS row, transaction_number, ask, answer FROM m WHERE e")
def stitched_transactions(spark, sf_dir):
    rows = transactions.exclude_rows(turns(spark, sf_dir), [Rule("note", "^The")], ["conv_id", "page", "row"])
    rows = transactions.flag_rows(rows, [Bookend(("ask",), ("answer",))], ["conv_id", "page", "row"])
    return transactions.stitch(rows, ["ask", "answer", "note"], ["conv_id"], ["page", "row"], fill=["ask"], merge=["answer"], separator=" / ").select("conv_id", F.col("row").cast("long").alias("row"), "transaction_number", "ask", "answer")


@query(STITCH_SQL + "SELECT conv_id, CAST(row AS BIGINT) AS row, s AS transaction_start, e AS transaction_end FROM f")
def bookend_flags(spark, sf_dir):
    rows = transactions.exclude_rows(turns(spark, sf_dir), [Rule("note", "^The")], ["conv_id", "page", "row"])
    rows = transactions.flag_rows(rows, [Bookend(("ask",), ("answer",))], ["conv_id", "page", "row"])
    return rows.select("conv_id", F.col("row").cast("long").alias("row"), "transaction_start", "transaction_end").distinct()


# Standard fields over orders written as bank text

STANDARDS = [
    standard.Standard("STD_TRANSACTION_DATE", "date", True, (standard.Reference("A", field="period", format="%d %B %Y"),)),
    standard.Standard("STD_TRANSACTION_DESC", references=(standard.Reference("A", concat=("kind", "note"), terminator="BALANCE CARRIED"),)),
    standard.Standard("STD_PAYMENTS_IN", "numeric", references=(standard.Reference("A", field="amount", exclude_negative=True),)),
    standard.Standard("STD_PAYMENTS_OUT", "numeric", references=(standard.Reference("A", field="amount", exclude_positive=True, multiplier=-1.0),)),
    standard.Standard("STD_CURRENCY", references=(standard.Reference("A", default="GBP"),)),
    standard.Standard("STD_SORTCODE"),
]


@query(r"""WITH s AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS known, o_orderpriority AS kind,
  ' no ' || o_orderkey || CASE WHEN o_orderstatus = 'O' THEN ' BALANCE CARRIED FORWARD' ELSE '' END AS note, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS a FROM orders)
SELECT o_orderkey, last_value(known IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS STD_TRANSACTION_DATE,
  CASE WHEN instr(kind || note, 'BALANCE CARRIED') > 1 THEN substr(kind || note, 1, instr(kind || note, 'BALANCE CARRIED') - 1) ELSE kind || note END AS STD_TRANSACTION_DESC,
  CAST(CAST(greatest(a, 0) AS DECIMAL(16,4)) AS DOUBLE) AS STD_PAYMENTS_IN, CAST(CAST(-least(a, 0) AS DECIMAL(16,4)) AS DOUBLE) AS STD_PAYMENTS_OUT, 'GBP' AS STD_CURRENCY, CAST(NULL AS VARCHAR) AS STD_SORTCODE FROM s""")
def standard_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    written = F.when(F.col("o_orderstatus") == "P", F.lit(None)).when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("1 May to "), F.date_format(day, "d MMMM yyyy"))).otherwise(F.date_format(day, "dd MMMM yyyy"))
    rows = o.select("o_orderkey", "o_custkey", day.alias("d"), written.alias("period"), F.col("o_orderpriority").alias("kind"),
                    F.concat(F.lit(" no "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "O", " BALANCE CARRIED FORWARD").otherwise("")).alias("note"),
                    F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).cast("decimal(16,4)").cast("string").alias("amount"))
    out = standard.map_fields(rows, STANDARDS, "A", ["o_custkey"], ["d", "o_orderkey"])
    return out.select("o_orderkey", "STD_TRANSACTION_DATE", "STD_TRANSACTION_DESC", F.col("STD_PAYMENTS_IN").cast("double").alias("STD_PAYMENTS_IN"), F.col("STD_PAYMENTS_OUT").cast("double").alias("STD_PAYMENTS_OUT"), "STD_CURRENCY", "STD_SORTCODE")


# Exports


@query(over_ledger("""SELECT strftime(transaction_date, '%d/%m/%Y') AS "Date", translate(transaction_desc, '!@#$%^&*(),.?":{}|<>', '') AS "Description", round(value_in - value_out, 2) AS "Amount" FROM flat_transaction"""))
def export_three_columns(spark, sf_dir):
    return export.mapped(parts(spark, sf_dir)[1]["FlatTransaction"], export.THREE_COLUMN)


@query(over_ledger("""SELECT strftime(transaction_date, '%d/%m/%Y') AS "Date", translate(transaction_desc, '!@#$%^&*(),.?":{}|<>', '') AS "Description", nullif(round(value_in, 2), 0) AS "Credit", nullif(round(value_out, 2), 0) AS "Debit" FROM flat_transaction"""))
def export_four_columns(spark, sf_dir):
    return export.mapped(parts(spark, sf_dir)[1]["FlatTransaction"], export.FOUR_COLUMN)


@query(over_ledger("""SELECT transaction_date AS "Date", -(value_in - value_out) AS "Amount" FROM flat_transaction WHERE account_number = '00000007' AND transaction_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'"""))
def export_filtered(spark, sf_dir):
    spec = export.Spec("FlatTransaction", (("Date", "transaction_date"), ("Amount", export.SIGNED)), invert_polarity=True)
    return export.mapped(export.filtered(parts(spark, sf_dir)[1]["FlatTransaction"], "FlatTransaction", account="00000007", since="1994-01-01", until="1996-12-31"), spec)


@query(over_ledger("""SELECT id_statement, id_account, statement_date, id_account || '_' || strftime(statement_date, '%Y%m%d') || CASE WHEN count(*) OVER w > 1 THEN '_' || row_number() OVER (PARTITION BY id_account, statement_date ORDER BY id_statement) ELSE '' END AS file_name
  FROM dim_statement WINDOW w AS (PARTITION BY id_account, statement_date)"""))
def export_file_names(spark, sf_dir):
    return export.split_names(parts(spark, sf_dir)[1]["DimStatement"])


@query(over_ledger("SELECT id_account, id_date AS day, value_in FROM (SELECT id_account, id_date, value_in FROM fact_transaction)"))
def iso_sniffing(spark, sf_dir):
    rows = parts(spark, sf_dir)[1]["FactTransaction"].select("id_account", F.col("id_date").cast("string").alias("day"), "value_in")
    return reports.sniffed(rows)


@query(over_ledger("""SELECT '{"account_int":' || account_int || ',"id_account":"' || id_account || '","currency":"' || currency || '"}' AS json FROM dim_account"""))
def json_export(spark, sf_dir):
    return reports.json_rows(parts(spark, sf_dir)[1]["DimAccount"].select("account_int", "id_account", "currency"))


# Keyed changes and housekeeping


@query(over_ledger("SELECT ID_BATCHLINE, STD_FILENAME, STD_BATCH_LINE FROM batch_lines WHERE ID_BATCH <> 'BX' UNION ALL SELECT ID_BATCHLINE, upper(STD_FILENAME), STD_BATCH_LINE + 1000 FROM batch_lines WHERE ID_BATCH = 'BX'"))
def keyed_upsert(spark, sf_dir):
    b = ledger(spark, sf_dir)["batch_lines"].select("ID_BATCHLINE", "STD_FILENAME", "STD_BATCH_LINE")
    again = b.where("ID_BATCHLINE like 'BX%'").select("ID_BATCHLINE", F.upper("STD_FILENAME").alias("STD_FILENAME"), (F.col("STD_BATCH_LINE") + 1000).alias("STD_BATCH_LINE"))
    return keyed.upsert(b, again, ["ID_BATCHLINE"])


@query(over_ledger("SELECT * FROM batch_lines WHERE ID_STATEMENT NOT IN (SELECT ID_STATEMENT FROM statement_heads WHERE STD_ACCOUNT = 'MACHINERY')"))
def keyed_delete(spark, sf_dir):
    raw = ledger(spark, sf_dir)
    return keyed.delete(raw["batch_lines"], raw["statement_heads"].where("STD_ACCOUNT = 'MACHINERY'"), ["ID_STATEMENT"])


@query(over_ledger("""SELECT 'batch_lines' AS table_name, 'ID_BATCH' AS fk_column, 'batch_heads' AS parent_table, count(*) AS orphans, coalesce((SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT DISTINCT ID_BATCH AS i FROM batch_lines WHERE ID_BATCH NOT IN (SELECT ID_BATCH FROM batch_heads) ORDER BY 1 LIMIT 10)), '') AS first_ids
  FROM batch_lines WHERE ID_BATCH NOT IN (SELECT ID_BATCH FROM batch_heads)
UNION ALL SELECT 'statement_heads', 'ID_BATCHLINE', 'batch_lines', count(*), '' FROM statement_heads WHERE ID_BATCHLINE NOT IN (SELECT ID_BATCHLINE FROM batch_lines)
UNION ALL SELECT 'statement_lines', 'ID_STATEMENT', 'statement_heads', count(*), '' FROM statement_lines WHERE ID_STATEMENT NOT IN (SELECT ID_STATEMENT FROM statement_heads)"""))
def orphan_report(spark, sf_dir):
    return keyed.report(ledger(spark, sf_dir))


@query(over_ledger("""SELECT l.ID_TRANSACTION, l.ID_STATEMENT FROM statement_lines l JOIN statement_heads h USING (ID_STATEMENT) JOIN batch_lines b USING (ID_BATCHLINE) WHERE b.ID_BATCH IN (SELECT ID_BATCH FROM batch_heads)"""))
def cleanup_cascade(spark, sf_dir):
    return keyed.cleaned(ledger(spark, sf_dir))["statement_lines"].select("ID_TRANSACTION", "ID_STATEMENT")


@query(over_ledger(f"""SELECT h.ID_STATEMENT, h.ID_ACCOUNT FROM statement_heads h JOIN cab USING (ID_STATEMENT) WHERE {VERDICT}""", cab=CAB))
def batch_commit(spark, sf_dir):
    raw = ledger(spark, sf_dir)
    cab = cab_of(raw)
    results = cab.select("ID_STATEMENT", F.when(F.col("SUCCESS"), "SUCCESS").otherwise("REVIEW").alias("result"))
    return store.routed({**raw, "results": results, "checks_and_balances": checks.record(cab, raw["batch_lines"])})["statement_heads"].select("ID_STATEMENT", "ID_ACCOUNT")


# Exchange rates: working days of the event table, one quote a currency


QUOTES = """SELECT DISTINCT CAST(o_orderdate AS DATE) AS id_date, currency, 0.5 + (day(o_orderdate) + k) / 64.0 AS quote FROM orders, (VALUES ('GBP', 1), ('EUR', 5), ('JPY', 9)) c(currency, k)
  WHERE isodow(o_orderdate) < 6 AND day(o_orderdate) > 5"""


def quotes(spark, sf_dir) -> DataFrame:
    """A quote for each working day with orders after the fifth of a month, for three currencies."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("id_date")).distinct().where("weekday(id_date) < 5 and day(id_date) > 5")
    codes = F.explode(F.array(*(F.struct(F.lit(c).alias("currency"), F.lit(k).alias("k")) for c, k in (("GBP", 1), ("EUR", 5), ("JPY", 9)))))
    return days.select("id_date", codes.alias("c")).select("id_date", "c.currency", (0.5 + (F.day("id_date") + F.col("c.k")) / 64.0).cast("double").alias("quote"))


FILLED = f"""q AS ({QUOTES}), r AS (SELECT id_date, currency, 1.0 / CAST(quote AS DOUBLE) AS rate FROM q),
x AS (SELECT d.id_date, c.currency FROM dim_date d CROSS JOIN (SELECT DISTINCT currency FROM r) c),
fill AS (SELECT x.id_date, x.currency, last_value(rate IGNORE NULLS) OVER (PARTITION BY x.currency ORDER BY x.id_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate_usd FROM x LEFT JOIN r ON r.id_date = x.id_date AND r.currency = x.currency)"""


@query(over_ledger("SELECT id_date, currency, rate_usd FROM fill WHERE rate_usd IS NOT NULL").replace("\nSELECT id_date, currency, rate_usd FROM fill", f",\n{FILLED}\nSELECT id_date, currency, rate_usd FROM fill"))
def fx_forward_fill(spark, sf_dir):
    return fx.filled(fx.inverted(quotes(spark, sf_dir)), parts(spark, sf_dir)[1]["DimDate"])


@query(over_ledger("SELECT id_date, currency, rate_usd FROM fill WHERE rate_usd IS NOT NULL AND currency IN (SELECT currency FROM dim_account) UNION ALL SELECT DATE '1900-01-01', 'GBP', 1.5").replace("\nSELECT id_date, currency, rate_usd FROM fill", f",\n{FILLED}\nSELECT id_date, currency, rate_usd FROM fill"))
def fx_enrichment(spark, sf_dir):
    m = parts(spark, sf_dir)[1]
    have = spark.createDataFrame([("1900-01-01", "GBP", 1.5)], "id_date string, currency string, rate_usd double").withColumn("id_date", F.col("id_date").cast("date"))
    return fx.enrich(have, quotes(spark, sf_dir), m["DimAccount"], m["DimDate"])
