import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import checks, keyed, transactions
from ledgerloom.operators.identify import Probe, identify, locations
from ledgerloom.operators.transactions import Bookend, Rule
from ledgerloom.plans.store import KEYS, Store, commit
from ledgerloom.sources import config, grids, mock
from ledgerloom.streaming import ingest

RECORD = "s string, page int, row int, field string, value string, success boolean"


def test_stitching(spark):
    rows = [("a", 1, 0, "d", None, False), ("a", 1, 1, "d", "1 Jan", True), ("a", 1, 1, "t", "X", True), ("a", 1, 2, "t", "Y", True), ("a", 1, 2, "v", "5", True), ("a", 1, 3, "t", "Z", True),
            ("a", 1, 4, "t", "SKIP", True), ("a", 1, 4, "v", "9", True), ("a", 2, 0, "d", "2 Jan", True), ("a", 2, 0, "v", "7", True), ("a", 2, 1, "v", "8", True)]
    keys = ["s", "page", "row"]
    df = transactions.exclude_rows(spark.createDataFrame(rows, RECORD), [Rule("t", "^SKIP$")], keys)
    df = transactions.flag_rows(df, [Bookend(("d",), ("v",))], keys)
    got = transactions.stitch(df, ["d", "t", "v"], ["s"], ["page", "row"], fill=["d"], merge=["t"], separator="+").orderBy("page", "row").collect()
    assert [(r.transaction_number, r.d, r.t, r.v) for r in got] == [(1, "1 Jan", "X+Y+Z", "5"), (2, "2 Jan", "", "7"), (2, "2 Jan", "", "8")]


def test_condition_rules_out_both_ends(spark):
    df = spark.createDataFrame([("a", 1, 0, "d", "x", True), ("a", 1, 0, "v", "bad", True), ("a", 1, 1, "d", "x", True), ("a", 1, 1, "v", None, True)], RECORD)
    got = {r.row: (r.transaction_start, r.transaction_end) for r in transactions.flag_rows(df, [Bookend(("d",), ("v",), only_if=Rule("v", "^ok"))], ["s", "page", "row"]).collect()}
    assert got == {0: (False, False), 1: (True, True)}


HEAD = "ID_STATEMENT string, STD_OPENING_BALANCE decimal(16,4), STD_PAYMENTS_IN decimal(16,4), STD_PAYMENTS_OUT decimal(16,4), STD_CLOSING_BALANCE decimal(16,4)"
LINE = ("ID_STATEMENT string, STD_TRANSACTION_NUMBER long, STD_TRANSACTION_DATE string, STD_TRANSACTION_DESC string, STD_TRANSACTION_PAYMENTS_IN decimal(16,4), STD_TRANSACTION_PAYMENTS_OUT decimal(16,4), "
        "STD_TRANSACTION_MOVEMENT decimal(16,4), STD_RUNNING_BALANCE decimal(16,4)")


def test_checks(spark):
    from decimal import Decimal as D

    heads = [(k, D(10), D(i), D(2), D(c)) for k, i, c in (("good", 5, 13), ("in", 6, 13), ("dates", 5, 13), ("none", 5, 13))] + [("zero", D(1), D(0), D(0), D(9))]
    lines = [(k, 1, None if k == "dates" else "d", "t", D(5), D(0), D(5), D(15)) for k in ("good", "in", "dates")] + [(k, 2, "d", "t", D(0), D(2), D(-2), D(13)) for k in ("good", "in", "dates")]
    lines.append(("zero", 1, None, None, D(0), D(0), D(0), D(1)))
    cab = checks.detail(checks.balance(spark.createDataFrame(heads, HEAD), spark.createDataFrame(lines, LINE)))
    got = {r.ID_STATEMENT: r for r in cab.collect()}
    assert {k: r.SUCCESS for k, r in got.items()} == {"good": True, "in": False, "dates": False, "none": False, "zero": True}
    assert got["good"].detail == "" and "BAL_PAYMENTS_IN stated=6.0000 extracted=5.0000 delta=1.00" in got["in"].detail and not got["in"].BAL_MOVEMENT


def test_outcomes(spark):
    flags = [("success", 0, 0, 0, 0), ("review", 0, 1, 0, 0), ("config", 1, 0, 0, 0), ("data", 0, 1, 1, 0), ("other", 0, 0, 0, 1)]
    df = spark.createDataFrame([(k, *map(bool, f)) for k, *f in flags], "k string, error_config boolean, error_cab boolean, error_data boolean, error_other boolean")
    assert {r.k: r.outcome for r in checks.outcome(df).collect()} == {"success": "SUCCESS", "review": "REVIEW CAB", "config": "FAILURE CONFIG", "data": "FAILURE DATA", "other": "FAILURE OTHER"}


def test_store(spark, tmp_path):
    raw = mock.make(spark, 2, 3, 4)
    cab = raw["batch_lines"].select(F.col("ID_BATCHLINE").alias("ID_CAB"), "ID_BATCHLINE", "ID_BATCH")
    raw["checks_and_balances"] = cab
    store = Store(spark, str(tmp_path), {k: raw[k].schema for k in KEYS})
    first = raw["statement_heads"].orderBy("ID_STATEMENT").first().ID_STATEMENT
    batch = raw | {"results": raw["statement_heads"].select("ID_STATEMENT", F.when(F.col("ID_STATEMENT") == first, "REVIEW").otherwise("SUCCESS").alias("result"))}
    for _ in range(2):  # again changes nothing
        assert commit(store, batch)
        assert store.read("statement_heads").count() == 5 and store.read("statement_lines").count() == 20 and store.read("batch_lines").count() == 6
    with pytest.raises(ValueError):
        store.update("batch_heads", raw["batch_heads"].unionByName(raw["batch_heads"]))
    store.append("batch_heads", raw["batch_heads"])
    assert store.read("batch_heads").count() == 4
    store.delete("batch_heads", raw["batch_heads"])
    assert store.read("batch_heads").count() == 0


def test_orphans(spark):
    t = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    raw = {"batch_heads": t([("b1",)], "ID_BATCH string"), "batch_lines": t([("l1", "b1"), ("l2", "gone"), ("l3", None)], "ID_BATCHLINE string, ID_BATCH string"),
           "statement_heads": t([("s1", "l1"), ("s2", "l2"), ("s3", "l3")], "ID_STATEMENT string, ID_BATCHLINE string"), "statement_lines": t([("s1",), ("s2",), ("s9",)], "ID_STATEMENT string")}
    assert {(r.table_name, r.orphans, r.first_ids) for r in keyed.report(raw).collect()} == {("statement_heads", 0, ""), ("statement_lines", 1, "s9"), ("batch_lines", 1, "gone")}
    clean = keyed.cleaned(raw)
    assert {r.ID_STATEMENT for r in clean["statement_lines"].collect()} == {"s1"} and clean["batch_lines"].count() == 2


def test_identify_and_locations(spark):
    df = spark.createDataFrame([("x NatBank y",), ("Other",), (None,)], "t string")
    assert [r.config for r in identify(df, "t", [Probe("A", "Nat"), Probe("B", "Bank|Other")]).collect()] == ["A", "B", None]
    pages, spots = spark.createDataFrame([("d", 4)], "doc_id string, n_pages int"), spark.createDataFrame([("d", "head", 1), ("d", "lines", None)], "doc_id string, location string, page int")
    assert {(r.location, r.page) for r in locations(pages, spots, 1).collect()} == {("head", 1), ("lines", 2), ("lines", 3)}


def test_grids(spark):
    paged = spark.createDataFrame([("d", 1, "Date  Amount\n\n1 Jan  5.00")], "doc_id string, page int, text string")
    rows = grids.strip_header(grids.grid(paged), "DATE amount")
    assert [r.cells for r in rows.collect()] == [["1 Jan", "5.00"]] and grids.at_least(rows, 3).count() == 0
    boxes = spark.createDataFrame([(1.0, 1.0, 2.0, 2.0), (8.0, 1.0, 9.0, 2.0)], "x0 double, y0 double, x1 double, y1 double")
    assert grids.crop(boxes, right=5).count() == 1 and grids.crop(boxes).count() == 2


def test_config(tmp_path):
    (tmp_path / "bank").mkdir()
    (tmp_path / "companies.toml").write_text('[bank]\nname = "Bank"\n')
    (tmp_path / "bank" / "accounts.toml").write_text('[a]\ncompany_key = "bank"\ncurrency = "GBP"\n')
    assert config.load(tmp_path)["accounts"]["a"]["currency"] == "GBP"
    (tmp_path / "bank" / "accounts.toml").write_text('[a]\ncurrency = "XXX"\n')
    with pytest.raises(config.ConfigError):
        config.load(tmp_path)
    f = config.field({"field": "x", "type": "currency", "numeric_modifier": {"suffix": "D", "multiplier": -1}}, "GBP")
    assert f.currency == "GBP" and f.modifier.suffix == "D"


def test_streaming_upsert(spark, tmp_path):
    heads = mock.make(spark, 1, 4, 1)["batch_heads"]
    heads.write.parquet(str(tmp_path / "drop"))
    store = Store(spark, str(tmp_path / "store"), {"batch_heads": heads.schema})
    for _ in range(2):
        ingest.into_store(ingest.watch(spark, str(tmp_path / "drop"), heads.schema), store, "batch_heads", str(tmp_path / "cp")).awaitTermination()
    assert store.read("batch_heads").count() == heads.count()
