"""Price-strategy questions (AG-07..AG-11) over ``plans.frames.price_frame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.bins import PRICE_BIN_LABELS, SEGMENT_LABELS, label_of, price_bin
from marketlens.operators.aggregates.common import complete_bins, js_round
from marketlens.operators.ranking import global_ordinal_rank


def price_bin_sales(df: DataFrame) -> DataFrame:
    """AG-10: listings and sales mean/median per price bin (zeros included).

    One grouped aggregate (partial+final), then completion to all ten bins.
    """
    b = price_bin(F.col("price_cents"), scale=100)
    g = (df.where(F.col("price_cents") >= 0).withColumn("price_bin", b)
         .groupBy("price_bin")
         .agg(F.count(F.lit(1)).alias("listings"),
              F.avg("sales").alias("sales_mean"),
              F.median("sales").alias("sales_median")))
    return complete_bins(g, "price_bin", PRICE_BIN_LABELS,
                         {"listings": 0, "sales_mean": 0.0, "sales_median": 0.0})


def market_gaps(bin_sales: DataFrame, how: str = "median") -> DataFrame:
    """AG-11: bins with few listings but strong sales.

    gap = listings / max(listings) < 0.3 and rounded sales / max(rounded sales)
    > 0.15, both maxima floored at 1. The maxima come from the ten-row frame.
    """
    s = js_round(F.col(f"sales_{how}")).cast("bigint")
    w = Window.partitionBy()   # ten rows: a single-partition window is intended here
    return (bin_sales.withColumn("bin_sales", s)
            .withColumn("max_listings", F.greatest(F.max("listings").over(w), F.lit(1)))
            .withColumn("max_sales", F.greatest(F.max("bin_sales").over(w), F.lit(1)))
            .select("price_bin", "price_bin_label", "listings", "bin_sales",
                    ((F.col("listings") / F.col("max_listings") < 0.3)
                     & (F.col("bin_sales") / F.col("max_sales") > 0.15)).alias("is_gap")))


def segment_share(df: DataFrame) -> DataFrame:
    """AG-09: listings per segment and share of all listings."""
    g = df.groupBy("segment").agg(F.count(F.lit(1)).alias("listings"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return complete_bins(g.withColumnRenamed("segment", "segment"), "segment",
                         SEGMENT_LABELS, {"listings": 0}) \
        .withColumn("share", F.col("listings") / total)


def price_kpis(df: DataFrame) -> DataFrame:
    """AG-07: mean/median price, dominant segment (ties -> cheaper) and its share,
    rows, rows with sales and their share. One aggregate over a segment histogram."""
    seg = (df.groupBy("segment").agg(F.count(F.lit(1)).alias("n")))
    dom = seg.agg(F.max_by(F.col("segment"), F.struct(F.col("n"), -F.col("segment"))).alias("s"),
                  F.max("n").alias("n"))
    base = df.agg(F.avg("price_cents").alias("mean_price_cents"),
                  F.median("price_cents").alias("median_price_cents"),
                  F.count(F.lit(1)).alias("listings"),
                  F.count_if(F.col("sales") > 0).alias("listings_with_sales"))
    return (base.withColumns({
        "dominant_segment": dom.select("s").scalar(),
        "dominant_listings": dom.select("n").scalar()})
        .select("mean_price_cents", "median_price_cents", "listings", "listings_with_sales",
                (F.col("listings_with_sales") / F.col("listings")).alias("with_sales_share"),
                F.col("dominant_segment"),
                label_of(F.col("dominant_segment"), SEGMENT_LABELS).alias("dominant_segment_label"),
                (F.col("dominant_listings") / F.col("listings")).alias("dominant_share")))


def spearman_price_sales(df: DataFrame, min_rows: int = 30) -> DataFrame:
    """AG-08: Spearman correlation of price and sales over rows with sales > 0.

    Ordinal ranks (ties broken by the row key = input order, like the
    reference's stable sort) come from the distributed rank W-03 on each
    measure; with no ties
    rho = 1 - 6 sum d^2 / (n (n^2 - 1)), computed in exact decimal.
    0 when n <= ``min_rows``.
    """
    key = ["row_k1", "row_k2", "row_k3", "asin"]
    pos = df.where(F.col("sales") > 0).select(*key, "price_cents", "sales")
    rp = global_ordinal_rank(pos.select(*key, "price_cents"), ["price_cents", *key], "rx")
    rs = global_ordinal_rank(pos.select("asin", "sales", *key[:3]), ["sales", *key], "ry")
    rp, rs = rp.select("asin", "rx"), rs.select("asin", "ry")
    j = rp.join(rs, "asin")
    d = (F.col("rx") - F.col("ry")).cast("decimal(38,0)")
    agg = j.agg(F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("sd2"))
    n = F.col("n").cast("decimal(38,0)")
    rho = F.lit(1.0) - (F.col("sd2") * 6).cast("double") / (n * (n * n - 1)).cast("double")
    return agg.select("n", F.when(F.col("n") > min_rows, rho).otherwise(F.lit(0.0)).alias("spearman"))
