import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from vahini.functions import money, text
from vahini.functions.dates import days_close


def values(spark, rows, expr, schema="v string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(expr).collect()]


def test_parse_amount(spark):
    cases = {
        "Rs. 3,83,92,892": 38392892, "₹ 1 234.50": Decimal("1234.5"), "1,234,567.89": Decimal("1234567.89"), "1.234.567,89": Decimal("1234567.89"), "12,5": Decimal("12.5"), "-45": -45, "(1,000)": -1000, "500/-": 500,
        "०.५": Decimal("0.5"), "0": 0, "": None, "text only": None, None: None, "1 234": 1234, "9" * 400: None,
    }
    assert values(spark, list(cases), money.parse_amount(F.col("v"))) == [None if v is None else Decimal(v) for v in cases.values()]


def test_scaled_amount(spark):
    got = values(spark, ["2.5 crore", "3 lakh", "१० लाख", "250000 lakh", "7", None, "x"], money.scaled_amount(F.col("v")))
    assert got == [Decimal(25_000_000), Decimal(300_000), Decimal(1_000_000), Decimal(250_000), Decimal(7), None, None]


def test_format(spark):
    cases = {"12345678.00": "₹1.23 Cr", "123456.00": "₹1.23 L", "2345.00": "₹2,345", "0.00": "₹0", "-150000.00": "-₹1.5 L", "99999.50": "₹1,00,000", None: "-", "1234567890.00": "₹123.46 Cr"}
    got = values(spark, list(cases), money.format_inr(F.col("v").cast("decimal(28,6)")))
    assert got == list(cases.values())
    assert values(spark, ["1234567", "123", "12345", "1"], money.group_digits(F.col("v"))) == ["12,34,567", "123", "12,345", "1"]


def test_values_close(spark):
    rows = [(100.0, 102.0), (100.0, 103.0), (None, None), (None, 1.0), (0.0, 0.0), (98.0, 100.0)]
    assert values(spark, rows, money.values_close(F.col("a"), F.col("b")), "a double, b double") == [True, False, True, False, False, True]


def test_fillers(spark):
    assert values(spark, [None, "", " ", "N.A.", "निरंक", "TBD", "live", "Unknown"], text.is_filler(F.col("v"))) == [True, True, True, True, True, True, False, True]


def test_names(spark):
    assert values(spark, ["M/s Om Traders Pvt. Ltd.", "Shri A. B. Patil", "Pvt Ltd", "पाटील कंपनी", None], text.normal_name(F.col("v"))) == ["om traders", "a b patil", "pvt ltd", "पाटील कंपनी", None]
    assert values(spark, [("x constructions", "x constructions nagpur"), ("a b", "c d"), ("", "a"), (None, "a"), ("a b c d", "a b c e")], text.set_ratio(F.col("a"), F.col("b")), "a string, b string") == [100.0, 0.0, 0.0, None, 75.0]


def test_uuid5_equals_python(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    rows = [("a", "b"), ("", "ü"), ("नाव", None)]
    got = values(spark, rows, text.uuid5(ns, F.col("a"), F.col("b")), "a string, b string")
    assert got == [str(uuid.uuid5(uuid.UUID(ns), f"{a}|{b or ''}")) for a, b in rows]


def test_cells_and_chains(spark):
    assert values(spark, ["=1+1", "+x", "-3", "@a", "\tq", "ok", None], text.safe_cell(F.col("v"))) == ["'=1+1", "'+x", "'-3", "'@a", "'\tq", "ok", None]
    assert values(spark, ["A || B||  ||C", "", None], text.org_chain(F.col("v"))) == [["A", "B", "C"], [], None]
    assert values(spark, ["पाणी योजना", "road", None], text.first_rule(F.col("v"), [("पाणी", "water"), ("road", "road")], "none")) == ["water", "road", "none"]


def test_days_close(spark):
    rows = [("2026-01-01", "2026-01-02"), ("2026-01-01", "2026-01-03"), (None, None), (None, "2026-01-01")]
    assert values(spark, rows, days_close(F.col("a").cast("date"), F.col("b").cast("date")), "a string, b string") == [True, False, True, False]
