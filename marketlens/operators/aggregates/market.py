"""Market overview and table KPIs (AG-01..AG-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.bins import RATING_BIN_LABELS, rating_bin
from marketlens.operators.aggregates.common import complete_bins, zero_if_null


def table_kpis(df: DataFrame, category_col: str = "crawl_category") -> DataFrame:
    """AG-01: distinct products, rows, distinct categories, best-seller share (%)."""
    return df.agg(F.count_distinct("asin").alias("products"),
                  F.count(F.lit(1)).alias("records"),
                  F.count_distinct(category_col).alias("categories"),
                  zero_if_null(F.avg(F.col("is_best_seller").cast("int")) * 100)
                  .alias("best_seller_pct"))


def market_kpis(df: DataFrame) -> DataFrame:
    """AG-02: listings, price and sales mean & median, mean rating (zeros
    included), Amazon's-choice count and share. Empty input gives zeros."""
    return df.agg(
        F.count(F.lit(1)).alias("listings"),
        zero_if_null(F.avg("price_cents")).alias("price_mean_cents"),
        zero_if_null(F.median("price_cents")).alias("price_median_cents"),
        zero_if_null(F.avg("sales")).alias("sales_mean"),
        zero_if_null(F.median("sales")).alias("sales_median"),
        zero_if_null(F.avg("rating_x10") / 10).alias("rating_mean"),
        F.count_if("is_amazon_choice").alias("choice_listings"),
        zero_if_null(F.avg(F.col("is_amazon_choice").cast("int")) * 100).alias("choice_pct"))


def top_categories(df: DataFrame, k: int = 10) -> DataFrame:
    """AG-03: the k categories with most listings (ties by name)."""
    return (df.groupBy("category").agg(F.count(F.lit(1)).alias("listings"))
            .orderBy(F.col("listings").desc(), F.col("category")).limit(k))


# The three overlapping flags of the market tab.
MARKET_FLAGS = ["is_amazon_choice", "is_climate_friendly", "has_variations"]


def flag_counts(df: DataFrame) -> DataFrame:
    """AG-04: listings carrying each flag (one aggregate, long form)."""
    one = df.agg(*[F.count_if(c).alias(c) for c in MARKET_FLAGS])
    return one.unpivot([], MARKET_FLAGS, "flag", "listings")


def top_category_measures(df: DataFrame, k: int = 8) -> DataFrame:
    """AG-05: price and sales mean & median for the k largest categories.

    The top-k list is k rows (bounded), so it is broadcast into a semi join.
    """
    top = top_categories(df, k).select("category")
    return (df.join(F.broadcast(top), "category", "left_semi")
            .groupBy("category")
            .agg(F.count(F.lit(1)).alias("listings"),
                 F.avg("price_cents").alias("price_mean_cents"),
                 F.median("price_cents").alias("price_median_cents"),
                 F.avg("sales").alias("sales_mean"),
                 F.median("sales").alias("sales_median")))


def rating_distribution(df: DataFrame, keep_zero_quirk: bool = True) -> DataFrame:
    """AG-06: listings per rating bin (FE-16), all five bins."""
    g = (df.withColumn("rating_bin", rating_bin(F.col("rating_x10") / 10, keep_zero_quirk))
         .groupBy("rating_bin").agg(F.count(F.lit(1)).alias("listings")))
    return complete_bins(g, "rating_bin", RATING_BIN_LABELS, {"listings": 0})
