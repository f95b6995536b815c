from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import fields, standard
from ledgerloom.functions.fields import Field, Modifier
from ledgerloom.functions.regexlib import java

DETAIL = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+([A-Z0-9_\-/*.,&'\s]+)$"
ROWS = {
    "Card Transaction 0940 15JAN26 C WOODIES LEEDS GB": ("Card Transaction", "0940 15JAN26 C WOODIES LEEDS GB"),
    "Direct Debit CHRISTIAN AG POV": ("Direct Debit", "CHRISTIAN AG POV"),
    "Card Transaction 0940 15JAN26 C WOODIES LEEDS GB National Westminster Bank Plc": (None, None),
    "BROUGHT FORWARD Card Transaction 0940 24TDS25C HJSVQX": (None, None),
}


def run(spark, texts, field):
    df = spark.createDataFrame([(t, i, 1) for i, t in enumerate(texts)], "value_raw string, row int, page int")
    return [r.asDict() for r in fields.records(fields.read(df, field), ["row", "page"]).orderBy("row").collect()]


@pytest.mark.parametrize("group", [1, 2])
def test_groups(spark, group):
    got = run(spark, list(ROWS), Field("detail", pattern=DETAIL, group=group, vital=True))
    assert [r["value"] for r in got] == [v[group - 1] for v in ROWS.values()]
    assert [r["success"] for r in got] == [v[0] is not None for v in ROWS.values()]
    assert [r["hard_fail"] for r in got] == [v[0] is None for v in ROWS.values()]


def test_amounts(spark):
    suffix = Field("a", "currency", currency="GBP", modifier=Modifier(suffix="D", multiplier=-1))
    got = run(spark, ["£1,234.50", "12.00D", "12.00\n", "x", None, ""], suffix)
    assert [r["value"] for r in got] == ["1234.5000", "-12.0000", "12.0000", None, None, None]
    assert got[3]["error"] == "pattern error" and got[4]["error"] == "strip error"
    assert [r["value"] for r in run(spark, ["€1.234,50"], Field("a", "currency", currency="EUR"))] == ["1234.5000"]
    clamp = Field("a", "numeric", modifier=Modifier(exclude_negative=True))
    assert [r["value"] for r in run(spark, ["-3", "4"], clamp)] == ["0.0000", "4.0000"]
    assert [r["value"] for r in run(spark, ["[12.00]"], Field("a", strip_start="[", strip_end="]"))] == ["12.00"]


@pytest.mark.parametrize("pattern, text, hit", [(r"^[0-9.]+$", "12.00\n", False), (r"\d{2}\s+[A-Z]{3}+\s+\d{4}", "01 JANUAR 2024", True), (r"\d{2}\s+[A-Z]{1}+[a-z]{2}+", "01 Jan", True),
                                                (r"(ab){2}+c", "ababababc", True), (r"[$]a", "$a", True), (r"^(\d+)\s?$", "12", True), (r"(?:x|y)$", "ay", True)])
def test_pattern_syntax(spark, pattern, text, hit):
    assert spark.range(1).select(F.lit(text).rlike(java(pattern))).first()[0] is hit


def test_cells_and_offsets(spark):
    grid = spark.createDataFrame([("d", 1, 0, ["Total", "5.00", "x"]), ("d", 1, 1, ["Other", "6.00"])], "doc_id string, page int, row int, cells array<string>")
    one = fields.from_cell(grid, Field("t", cell=(0, 1)), ["doc_id"]).collect()
    assert [r.value for r in one] == ["5.00"] and not fields.from_cell(grid, Field("t", cell=(9, 0)), ["doc_id"]).collect()
    moved = fields.from_column(grid, [Field("t", column=0, pattern="Total", offset=fields.Offset(2, Field("v")))], ["doc_id"]).collect()
    assert [(r.field, r.value, r.value_raw) for r in moved] == [("t", "x", "Total")]
    long = fields.from_column(grid, [Field("a", column=0), Field("b", column=2)], ["doc_id"])
    assert long.count() == 4 and fields.scoped(long, "fail").count() == 1 and fields.scoped(long, "fail", transactions=True).count() == 4


def test_standard_fields(spark):
    df = spark.createDataFrame([("s", 1, "9 July to 8 August 2025", "HI BALANCE", "-2"), ("s", 2, None, "BALANCE", None)], "s string, row int, d string, t string, a string")
    Ref, Std = standard.Reference, standard.Standard
    got = standard.map_fields(df, [Std("D", "date", True, (Ref("x", field="d", format="%d %B %Y"),)), Std("T", references=(Ref("x", field="t", terminator="BALANCE"),)),
                                   Std("N", "numeric", references=(Ref("x", field="a", multiplier=-1),)), Std("O")], "x", ["s"], ["row"]).orderBy("row").collect()
    assert [(r.D, r["T"], float(r.N), r.O) for r in got] == [(date(2025, 8, 8), "HI ", 2.0, None), (date(2025, 8, 8), "BALANCE", 0.0, None)]
    with pytest.raises(standard.ConfigError):
        standard.map_fields(df, [Std("V", vital=True)], "x", ["s"], ["row"])
    assert standard.spark_format("%d/%m/%Y") == "dd/MM/yyyy" and standard.spark_format("%-d of %b") == "d 'of' MMM"


def test_statement_identity(spark):
    import hashlib

    got = standard.ids(spark.createDataFrame([("page é",), ("",), (None,)], "first_page string")).collect()
    assert [r.ID_STATEMENT for r in got] == [hashlib.sha512("page é".encode()).hexdigest(), hashlib.sha512(b"").hexdigest(), None]
