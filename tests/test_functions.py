"""Hand-worked cases for the scalar expressions (FIXTURES.md §4)."""

from pyspark.sql import functions as F

from marketlens.functions import bins, parse
from marketlens.functions import text as TX


def _one(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


def test_sales_parsers_truncate_vs_round(spark):
    rows = [("1K+ bought in past month",), ("1.5k+",), ("500+ bought",), ("2.5+",), ("3.5+",),
            ("0 bought in past month",), (None,)]
    trunc = _one(spark, rows, "s string", parse.sales_number_truncated("s"))
    rnd = _one(spark, rows, "s string", parse.sales_number_rounded("s"))
    assert trunc == [1000, 1500, 500, 2, 3, 0, 0]
    assert rnd == [1000, 1500, 500, 2, 4, None, None]


def test_delivery_fee_case(spark):
    rows = [("$14.78 delivery Tue",), ("$5 Delivery",), ("FREE delivery",)]
    assert _one(spark, rows, "s string", parse.delivery_fee_lenient("s")) == [14.78, 5.0, 0.0]
    assert _one(spark, rows, "s string", parse.delivery_fee_strict("s")) == [14.78, None, None]


def test_delivery_details_glued_text(spark):
    rows = [("$12 delivery Tue, Mar 31 Ships to VietnamOnly 5 left in stock",),
            ("No delivery information",)]
    out = _one(spark, rows, "s string", parse.delivery_details("s"))
    assert tuple(out[0]) == (12.0, "Tue, Mar 31", "Vietnam", "Only 5 left in stock")
    assert tuple(out[1]) == (0.0, None, None, None)


def test_placeholders_exact_match(spark):
    rows = [("[]",), ("{}",), ("",), ("missing value",), ("N/A",), ("nan",), (" [] ",), ("x",)]
    out = _one(spark, rows, "s string", TX.placeholder_to_null(F.col("s")))
    assert out == [None] * 6 + [" [] ", "x"]


def test_text_to_bool(spark):
    rows = [("TRUE ",), ("1",), ("Yes",), ("y",), ("t",), ("on",), ("1.0",), (None,)]
    assert _one(spark, rows, "s string", TX.text_to_bool("s")) == [True] * 4 + [False] * 4


def test_price_bins(spark):
    rows = [(0.0,), (4.99,), (5.0,), (200.0,), (1e6,), (-1.0,)]
    assert _one(spark, rows, "p double", bins.price_bin("p")) == [1, 1, 2, 10, 10, None]


def test_rating_bin_zero_quirk(spark):
    rows = [(0.0,), (1.0,), (1.01,), (5.0,)]
    assert _one(spark, rows, "r double", bins.rating_bin("r")) == [2, 1, 2, 5]
    assert _one(spark, rows, "r double", bins.rating_bin("r", keep_zero_quirk=False)) == [None, 1, 2, 5]


def test_discount_bins_edges(spark):
    rows = [(0.0,), (9.999,), (10.0,), (90.0,), (100.0,), (101.0,), (None,)]
    assert _one(spark, rows, "d double", bins.discount_bin10("d")) == [1, 1, 2, 10, 10, None, None]
    assert _one(spark, rows, "d double", bins.discount_bin5("d")) == [1, 1, 1, 5, 5, None, None]


def test_compact_number(spark):
    rows = [(999,), (1500,), (1250,), (2500000,)]
    assert _one(spark, rows, "v long", TX.compact_number("v")) == ["999", "1.5K", "1.3K", "2.5M"]


def test_slug(spark):
    rows = [("  Hello, World!  ",), ("---",), (None,)]
    assert _one(spark, rows, "s string", TX.slug("s")) == ["hello-world", "all", "all"]
