from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import export, fx, mart, reports, views
from ledgerloom.sources import mock


@pytest.fixture(scope="module")
def made(spark):
    raw = {k: v.cache() for k, v in mock.make(spark, 4, 6, 10).items()}
    m = {k: v.cache() for k, v in mart.build(raw).items()}
    return raw, m


def test_calendar(made):
    _, m = made
    d = m["DimDate"].orderBy("date_int").collect()
    assert [r.date_int for r in d] == list(range(1, len(d) + 1)) and (d[-1].id_date - d[0].id_date).days == len(d) - 1
    for r in d:
        assert r.quarter == r.id_date.month and r.week == int(r.id_date.strftime("%W")) and r.weekday == r.id_date.strftime("%A") and r.day_of_week == (r.id_date.weekday() + 1) % 7 + 1


def test_keys_are_dense(made):
    _, m = made
    for t, k, order in (("DimAccount", "account_int", "id_account"), ("DimStatement", "statement_int", "id_statement"), ("FactTransaction", "transaction_int", "id_transaction")):
        rows = m[t].orderBy(k).select(k, order).collect()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and [r[1] for r in rows] == sorted(r[1] for r in rows)


def test_facts_reconcile(made):
    raw, m = made
    kept = raw["statement_lines"].join(m["DimDate"], F.col("STD_TRANSACTION_DATE") == F.col("id_date"))
    want = kept.agg(F.count("*"), F.sum("STD_TRANSACTION_PAYMENTS_IN")).first()
    got = m["FactTransaction"].agg(F.count("*"), F.sum("value_in")).first()
    assert got[0] == want[0] and abs(got[1] - float(want[1])) < 0.005


def test_balance_grid(made):
    raw, m = made
    days, accounts = m["DimDate"].count(), m["DimAccount"].count()
    assert m["FactBalance"].count() == days * accounts == m["FactBalance"].select("date_int", "account_int").distinct().count()
    known = {(r.account_int, r.date_int): r for r in mart.daily(m["FactTransaction"], raw["statement_lines"]).collect()}
    for a in {k[0] for k in known}:
        last, moves = None, [k[1] for k in known if k[0] == a]
        for r in m["FactBalance"].where(F.col("account_int") == a).orderBy("date_int").collect():
            k = known.get((a, r.date_int))
            last = k.closing_balance if k else last
            assert r.closing_balance == last and r.outside_date == int(not min(moves) <= r.date_int <= max(moves)) and abs(r.movement - (k.movement if k else 0)) < 0.005
            if k:
                assert r.opening_balance == r.closing_balance


def test_empty_tables(spark, made):
    raw, _ = made
    m = mart.build({k: v.limit(0) for k, v in raw.items()})
    assert all(df.count() == 0 for df in m.values())


def test_views_and_scans(spark, made):
    raw, m = made
    v = views.build(m, raw)
    assert v["FlatTransaction"].count() == m["FactTransaction"].count() == v["FactTransactionBatch"].count()
    first = v["GapReport"].collect()
    assert {r.gap_flag for r in first} <= {"", "GAP"} and sum(r.gap_flag == "" for r in first) >= 1
    reports.register(m | dict(v))
    assert reports.scan(spark, "DimStatement", "BT001").count() == 6 and reports.counts(reports.collection(spark, "multi")).count() == 6
    with pytest.raises(ValueError):
        reports.scan(spark, "DimDate; DROP TABLE x")
    assert dict(reports.sniffed(spark.createDataFrame([("2024-01-02", "a"), (None, "b")], "d string, t string")).dtypes) == {"d": "date", "t": "string"}


def test_exports(spark, made, tmp_path):
    raw, m = made
    flat = views.flat_transaction(m)
    four = export.mapped(flat, export.FOUR_COLUMN).collect()
    assert not any(r.Credit and r.Debit for r in four)
    spec = export.from_dict({"meta": {"source_table": "FlatTransaction"}, "export": {}, "columns": {"A": export.SIGNED}, "format": {"invert_polarity": True}, "sanitise": {}})
    assert abs(export.mapped(flat, spec).agg(F.sum("A")).first()[0] + flat.agg(F.sum("value")).first()[0]) < 0.005
    export.export(flat, export.THREE_COLUMN, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == flat.count()
    none = spark.createDataFrame([(1.25, None, "a"), (2.0, 3.0, "b")], "x double, y double, file_name string")
    assert [tuple(r) for r in export.fixed(none, 0).orderBy("file_name").collect()] == [("1", None, "a"), ("2", "3", "b")]
    with pytest.raises(export.ConfigError):
        export.export(flat, export.replace(export.THREE_COLUMN, format="xlsx"), str(tmp_path / "x"))
    for bad in ({"meta": {}}, {"meta": {"source_table": "x"}, "export": {}, "columns": {"A": "b"}, "format": {}, "sanitise": {}}):
        with pytest.raises(export.ConfigError):
            export.from_dict(bad)
    with pytest.raises(export.ConfigError):
        export.filtered(m["DimDate"], "DimDate", account="x")


def rates(spark, rows):
    return spark.createDataFrame([(date.fromisoformat(d), c, r) for d, c, r in rows], fx.RATES)


def test_exchange_rates(spark):
    spine = lambda a, b: spark.sql(f"SELECT explode(sequence(DATE '{a}', DATE '{b}')) AS id_date")
    got = fx.filled(rates(spark, [("2024-03-15", "GBP", 1.265), ("2024-03-18", "GBP", 1.27)]), spine("2024-03-15", "2024-03-18")).orderBy("id_date").collect()
    assert [r.rate_usd for r in got] == [1.265, 1.265, 1.265, 1.27]
    assert fx.filled(rates(spark, [("2024-03-18", "EUR", 1.08)]), spine("2024-03-15", "2024-03-18")).count() == 1
    assert fx.filled(rates(spark, []), spine("2024-03-15", "2024-03-18")).count() == 0
    quotes = fx.fetch(spark, "2024-01-02", "2024-01-04", ["GBP", "AED"], "http://x", lambda u: b'{"rates": {"2024-01-02": {"GBP": 0.79, "EUR": 0}, "2024-01-04": {"GBP": 0.785}}}')
    out = fx.enrich(rates(spark, [("2024-01-04", "GBP", 9.0)]), quotes, spark.createDataFrame([("GBP",), (None,)], "currency string"), spine("2024-01-02", "2024-01-04"))
    assert [r.rate_usd for r in out.orderBy("id_date").collect()] == [1 / 0.79, 1 / 0.79, 9.0]
    with pytest.raises(ValueError):
        fx.codes(["gbp; --"])
