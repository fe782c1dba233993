"""Amazon's-choice badge questions (AG-27, AG-28) over ``plans.frames.badge_frame``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.bins import PRICE_TIER_LABELS
from marketlens.operators.aggregates.common import complete_bins, zero_if_null


def badge_vs_rest(df: DataFrame) -> DataFrame:
    """AG-27: listings with and without the badge, mean sales of each, uplift %,
    mean rating and mean reviews of badged listings. One aggregate."""
    b = F.col("is_amazon_choice")
    out = df.agg(
        F.count_if(b).alias("badge_listings"), F.count_if(~b).alias("other_listings"),
        zero_if_null(F.avg(F.when(b, F.col("sales")))).alias("badge_sales_mean"),
        zero_if_null(F.avg(F.when(~b, F.col("sales")))).alias("other_sales_mean"),
        zero_if_null(F.avg(F.when(b, F.col("rating_x10"))) / 10).alias("badge_rating_mean"),
        zero_if_null(F.avg(F.when(b, F.col("reviews")))).alias("badge_reviews_mean"))
    return out.withColumn("sales_uplift_pct", F.when(
        F.col("other_sales_mean") > 0,
        (F.col("badge_sales_mean") - F.col("other_sales_mean")) / F.col("other_sales_mean") * 100)
        .otherwise(F.lit(0.0)))


def badge_rate_by_tier(df: DataFrame) -> DataFrame:
    """AG-28: share (%) of badged listings per price tier, 0 for empty tiers."""
    g = df.groupBy("price_tier").agg(
        F.count(F.lit(1)).alias("listings"),
        (F.avg(F.col("is_amazon_choice").cast("int")) * 100).alias("badge_pct"))
    return complete_bins(g, "price_tier", PRICE_TIER_LABELS, {"listings": 0, "badge_pct": 0.0})
