"""Registered queries that go through files and sources: what they write is read back."""

from __future__ import annotations

import json
import tomllib
import uuid

from pyspark.sql import functions as F

from ledgerloom.functions import fields
from ledgerloom.operators import checks
from ledgerloom.plans import export, fx, kept, reports, store
from ledgerloom.plans.oracles import over_ledger
from ledgerloom.plans.queries import CAB, VERDICT, cab_of, ledger, parts, query, table
from ledgerloom.sources import config, grids, mock


def place(spark, name: str) -> str:
    """A folder in the shared place that nothing has used before."""
    return f"{kept.root(spark)}/{spark.sparkContext.applicationId}-files/{name}-{uuid.uuid4().hex}"


def text_pages(content: bytes) -> list[str]:
    """Pages of a plain text file."""
    return content.decode().split("\f")


@query("SELECT CAST(s_nationkey AS INT) AS nation, CAST(s_suppkey AS VARCHAR) AS supplier, s_name AS name FROM supplier")
def statement_files(spark, sf_dir):
    """Text files by nation, at most 1000 lines each, found again, read page by page and cut into cells."""
    path = place(spark, "files")
    lines = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.concat_ws("\t", F.col("s_suppkey").cast("string"), "s_name").alias("value"))
    lines.write.partitionBy("nation").option("maxRecordsPerFile", 1000).text(path)
    rows = grids.grid(grids.pages(grids.files(spark, path, "*.txt"), text_pages), "\t")
    return rows.select(F.regexp_extract("doc_id", r"nation=(\d+)", 1).cast("int").alias("nation"), F.get("cells", F.lit(0)).alias("supplier"), F.get("cells", F.lit(1)).alias("name"))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 600 >= 100 AND c_custkey % 800 >= 200 AND c_custkey % 600 + 20 <= 400 AND c_custkey % 800 + 10 <= 700""")
def region_crop(spark, sf_dir):
    words = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "c_custkey % 600 AS x0", "c_custkey % 800 AS y0", "c_custkey % 600 + 20 AS x1", "c_custkey % 800 + 10 AS y1")
    return grids.crop(words, 100, 200, 400, 700).select("c_custkey", "c_name")


FIELDS = tomllib.loads("""
[balance]
field = "balance"
type = "currency"
currency_override = "GBP"
cell = {row = 0, col = 1}
vital = true
numeric_modifier = {prefix = "-", multiplier = -1.0, exclude_negative_values = true}

[segment]
field = "segment"
cell = {row = 0, col = 2}
string_max_length = 4
""")


@query("""SELECT c_custkey AS doc_id, 'balance' AS field, greatest(CAST(c_acctbal AS DECIMAL(16,2)), 0) AS amount, CAST(NULL AS VARCHAR) AS text FROM customer
UNION ALL SELECT c_custkey, 'segment', NULL, left(c_mktsegment, 4) FROM customer""")
def configured_cells(spark, sf_dir):
    """Fields from configuration, read from cells of one-row grids; a balance below zero is 0."""
    balance = F.format_string("%.2f", F.col("c_acctbal").cast("double"))
    grid = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("row"), F.array("c_name", balance, "c_mktsegment").alias("cells"))
    out = [fields.from_cell(grid, config.field(raw), ["doc_id"]).select("doc_id", "field", "value") for raw in FIELDS.values()]
    amount = F.when(F.col("field") == "balance", F.col("value").cast("decimal(16,2)"))
    return out[0].unionByName(out[1]).select("doc_id", "field", amount.alias("amount"), F.when(F.col("field") != "balance", F.col("value")).alias("text"))


def provider(url: str) -> str:
    """An answer as a provider gives it: a quote of 1, 2, ... by the order of the codes asked for."""
    asked = url.rsplit("=", 1)[1].split(",")
    return json.dumps({"rates": {day: {c: i for i, c in enumerate(asked, 1)} for day in ("2024-01-02", "2024-01-03")}})


@query("""SELECT id_date, currency, 1.0 / CAST(k AS DOUBLE) AS rate_usd FROM (VALUES (DATE '2024-01-02'), (DATE '2024-01-03')) d(id_date), (VALUES ('CHF', 1), ('EUR', 2), ('GBP', 3)) c(currency, k)""")
def fx_source(spark, sf_dir):
    """Codes are sorted, and those that the provider lacks aren't asked for."""
    return fx.inverted(fx.fetch(spark, "2024-01-02", "2024-01-03", ["GBP", "AED", "EUR", "CHF", "EUR"], "https://rates.invalid", provider))


@query("""SELECT printf('ST%06d', s) AS ID_STATEMENT, printf('BT%03d_%d', s // 20, s % 20 + 1) AS ID_BATCHLINE, printf('BANK_CURRENT_%08d', s % 5) AS ID_ACCOUNT, CAST(50 AS BIGINT) AS lines FROM range(200) t(s)""")
def mock_ledger(spark, sf_dir):
    raw = mock.make(spark)
    lines = raw["statement_lines"].groupBy("ID_STATEMENT").agg(F.count("*").alias("lines"))
    return raw["statement_heads"].join(lines, "ID_STATEMENT").select("ID_STATEMENT", "ID_BATCHLINE", "ID_ACCOUNT", "lines")


@query(over_ledger("SELECT ID_BATCH, STD_PDF_COUNT FROM batch_heads UNION ALL SELECT ID_BATCH || '+', STD_PDF_COUNT FROM batch_heads"))
def parquet_append(spark, sf_dir):
    heads = ledger(spark, sf_dir)["batch_heads"]
    kept_heads = store.Store(spark, place(spark, "append"), {"batch_heads": heads.schema})
    kept_heads.append("batch_heads", heads)
    kept_heads.append("batch_heads", heads.withColumn("ID_BATCH", F.concat("ID_BATCH", F.lit("+"))))
    return kept_heads.read("batch_heads").select("ID_BATCH", "STD_PDF_COUNT")


@query(over_ledger(f"""SELECT 'batch_heads' AS table_name, count(*) AS row_count FROM batch_heads UNION ALL SELECT 'batch_lines', count(*) FROM batch_lines
UNION ALL SELECT 'checks_and_balances', count(*) FROM cab JOIN batch_lines USING (ID_STATEMENT)
UNION ALL SELECT 'statement_heads', count(*) FROM statement_heads JOIN cab USING (ID_STATEMENT) WHERE {VERDICT}
UNION ALL SELECT 'statement_lines', count(*) FROM statement_lines JOIN cab USING (ID_STATEMENT) WHERE {VERDICT}""", cab=CAB))
def commit_read_back(spark, sf_dir):
    """A batch committed twice: all tables at once, the second time without effect; rows of each as read back."""
    raw = ledger(spark, sf_dir)
    cab = cab_of(raw)
    results = cab.select("ID_STATEMENT", F.when(F.col("SUCCESS"), "SUCCESS").otherwise("REVIEW").alias("result"))
    batch = {**{n: raw[n] for n in ("batch_lines", "batch_heads", "statement_heads", "statement_lines")}, "results": results, "checks_and_balances": checks.record(cab, raw["batch_lines"])}
    target = store.Store(spark, place(spark, "commit"), {n: batch[n].schema for n in store.KEYS})
    for _ in range(2):
        store.commit(target, batch)
    return reports.counts({n: target.read(n) for n in store.KEYS})


SIGNED_SPEC = export.from_dict({"meta": {"source_table": "FactTransaction"}, "export": {"split_by_statement": True}, "columns": {"Id": "id_transaction", "Date": "id_date", "Amount": export.SIGNED},
                                "format": {"date_format": "%d/%m/%Y", "float_precision": 2}, "sanitise": {}})


@query(over_ledger("""SELECT id_transaction AS "Id", strftime(id_date, '%d/%m/%Y') AS "Date", printf('%.2f', value_in - value_out) AS "Amount" FROM fact_transaction"""))
def csv_read_back(spark, sf_dir):
    """An export as CSV files, read as text."""
    path = place(spark, "csv")
    export.export(parts(spark, sf_dir)[1]["FactTransaction"], export.replace(SIGNED_SPEC, split_by_statement=False), path)
    return spark.read.option("header", True).csv(path)


@query(over_ledger("""SELECT s.file_name, count(*) AS n, printf('%.2f', sum(CAST(value_in - value_out AS DECIMAL(16,2)))) AS total FROM fact_transaction f JOIN (
  SELECT id_statement, id_account || '_' || strftime(statement_date, '%Y%m%d') || CASE WHEN count(*) OVER w > 1 THEN '_' || row_number() OVER (PARTITION BY id_account, statement_date ORDER BY id_statement) ELSE '' END AS file_name
  FROM (SELECT DISTINCT id_statement, id_account, statement_date FROM dim_statement) WINDOW w AS (PARTITION BY id_account, statement_date)) s ON s.id_statement = f.id_statement GROUP BY s.file_name"""))
def csv_by_statement(spark, sf_dir):
    """One folder of CSV a statement, summed from what the files hold."""
    path, m = place(spark, "split"), parts(spark, sf_dir)[1]
    statements = m["DimStatement"].select("id_statement", "id_account", "statement_date").distinct()
    export.export(m["FactTransaction"], SIGNED_SPEC, path, statements)
    rows = spark.read.schema("Id string, Date string, Amount string, file_name string").option("header", True).csv(path)
    return rows.groupBy("file_name").agg(F.count("*").alias("n"), F.sum(F.col("Amount").cast("decimal(16,2)")).cast("string").alias("total"))


MULTI = (("DimAccount", "dim_account"), ("DimDate", "dim_date"), ("DimStatement", "dim_statement"), ("FactBalance", "fact_balance"), ("FactTransaction", "fact_transaction"), ("GapReport", "gap_report"))


@query(over_ledger("SELECT 'single' AS preset, 'FlatTransaction' AS table_name, count(*) AS row_count FROM flat_transaction UNION ALL " + " UNION ALL ".join(f"SELECT 'multi', '{n}', count(*) FROM {t}" for n, t in MULTI)))
def reporting_feed(spark, sf_dir):
    """Both presets as CSV folders, rows of each as read back."""
    path = place(spark, "feed")
    reports.register(parts(spark, sf_dir)[1])
    reports.feed(spark, path)
    out = None
    for preset, names in (("single", reports.SINGLE), ("multi", reports.MULTI)):
        one = reports.counts({n: spark.read.option("header", True).csv(f"{path}/{preset}/{n}") for n in names}).select(F.lit(preset).alias("preset"), "table_name", "row_count")
        out = one if out is None else out.unionByName(one)
    return out
