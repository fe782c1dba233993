"""Listing-completeness cells and adaptive bins on hand-made rows."""

from pyspark.sql import functions as F

from marketlens.functions.text import bool_domain
from marketlens.operators import clean as C
from marketlens.operators.aggregates import profile as PR
from marketlens.operators.aggregates import quality as Q


def _bins(spark, counts):
    rows = [("c", 1, k) for k, n in counts.items() for _ in range(n)]
    got = Q.adaptive_bins(spark.createDataFrame(rows, "category string, segment int, missing_count int"))
    return {r.mkey: (r.bin, r.bin_label) for r in got.where("cell_category = 'ALL' and cell_segment = 'ALL'").collect()}


def test_even_values_close_at_an_even_share(spark):
    # 14 values of one row: a share is 2, a bin closes once it holds more than 1.4
    got = _bins(spark, {k: 1 for k in range(1, 15)})
    assert got[1] == got[2] == (1, "1-2") and got[13] == got[14] == (7, "13-14")


def test_forced_starts_pool_and_last_bin(spark):
    got = _bins(spark, {14: 10, 15: 1, 40: 1, 60: 1})
    assert got == {14: (1, "14"), 15: (2, "15"), 999: (3, "34+")}


def test_lone_29_joins_30(spark):
    got = _bins(spark, {10: 20, 28: 20, 29: 20, 30: 20, 33: 20})
    assert got[29] == got[30] == (3, "29-31") and got[33] == (4, "33")


def test_rows_without_category_count_in_all(spark):
    rows = [(None, 1, 2)] * 5 + [("c", 1, 2)] * 15
    cells = Q.explode_cells(spark.createDataFrame(rows, "category string, segment int, missing_count int"))
    n = {(r[0], r[1]): r[2] for r in cells.groupBy(*Q.CELL).agg(F.count(F.lit(1))).collect()}
    assert n[("ALL", "ALL")] == 20 and n[("c", "ALL")] == 15 and all(c is not None for c, _ in n)


def test_boolean_domain_and_conform(spark):
    df = spark.createDataFrame([("yes", "t", 1.0), (" TRUE ", "y", float("nan")), ("false", None, 2.7)], "f string, g string, x double")
    assert [r[0] for r in df.select(bool_domain("f")).collect()] == [None, True, False]
    got = C.conform(df, {"g": ("boolean", False), "x": ("bigint", 0)}).collect()
    assert [(r.g, r.x) for r in got] == [(False, 1), (True, 0), (False, 2)]


def test_sales_stay_unknown_where_some_are_known(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", None)], "asin string, sales_volume_num double")
    assert {r.asin: r.sales_volume_num for r in C.preprocess(df.withColumn("price_cents", F.lit(1)).withColumn("is_prime", F.lit("true"))).collect()} == {"a": 5.0, "b": None}
    empty = df.where("asin = 'b'").withColumn("price_cents", F.lit(1))
    assert [r.sales_volume_num for r in C.preprocess(empty).collect()] == [0.0]


def test_constant_column_has_no_density(spark):
    assert PR.density_curve(spark.createDataFrame([(1.0,)] * 4, "v double"), "v").collect() == []


def test_unseen_category_is_all_zeros(spark):
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from marketlens.ml.modeling import feature_pipeline
    idx, ohe = [s for s in feature_pipeline().getStages() if isinstance(s, (StringIndexer, OneHotEncoder))]
    seen = spark.createDataFrame([("a",), ("b",)], "crawl_category string")
    new = spark.createDataFrame([("z",), ("a",)], "crawl_category string")
    im = idx.fit(seen)
    out = ohe.fit(im.transform(seen)).transform(im.transform(new)).collect()
    assert [r.crawl_category_ohe.toArray().tolist() for r in out] == [[0.0, 0.0], [1.0, 0.0]]
