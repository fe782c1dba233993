"""Rating and review questions (AG-20..AG-26) over ``plans.frames.trust_frame``.

Quantile thresholds (q75 of positive reviews, review quartiles over all
rows) are scalar subqueries: computed once, inlined as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.bins import (RATING_GROUP_LABELS, REVIEW_QUARTILE_LABELS,
                                       quartile_bucket, rating_group)
from marketlens.operators.aggregates.common import complete_bins, zero_if_null

HIGH_RATING_X10 = 45


def _mean_if(cond: Column, x: str) -> Column:
    return zero_if_null(F.avg(F.when(cond, F.col(x))))


def _median_if(cond: Column, x: str) -> Column:
    return zero_if_null(F.median(F.when(cond, F.col(x))))


def _uplift(a: Column, b: Column) -> Column:
    return F.when(b > 0, (a - b) / b * 100)


def rating_kpis(df: DataFrame) -> DataFrame:
    """AG-20: mean rating over rated listings (rating > 0) and total reviews."""
    return df.agg(zero_if_null(F.avg(F.when(F.col("rating_x10") > 0, F.col("rating_x10"))) / 10)
                  .alias("rating_mean"),
                  F.coalesce(F.sum("reviews"), F.lit(0)).cast("bigint").alias("reviews_total"))


def high_low_sales(df: DataFrame) -> DataFrame:
    """AG-21: sales mean & median of rating >= 4.5 vs < 4.5 (sales > 0), uplift %."""
    hi = (F.col("rating_x10") >= HIGH_RATING_X10) & (F.col("sales") > 0)
    lo = (F.col("rating_x10") < HIGH_RATING_X10) & (F.col("sales") > 0)
    out = df.agg(_mean_if(hi, "sales").alias("high_sales_mean"),
                 _mean_if(lo, "sales").alias("low_sales_mean"),
                 _median_if(hi, "sales").alias("high_sales_median"),
                 _median_if(lo, "sales").alias("low_sales_median"))
    return out.withColumns({
        "uplift_mean_pct": _uplift(F.col("high_sales_mean"), F.col("low_sales_mean")),
        "uplift_median_pct": _uplift(F.col("high_sales_median"), F.col("low_sales_median"))})


def high_low_price(df: DataFrame) -> DataFrame:
    """AG-22: mean price (price > 0) of rating >= 4.5 vs < 4.5 and the difference."""
    hi = (F.col("rating_x10") >= HIGH_RATING_X10) & (F.col("price_cents") > 0)
    lo = (F.col("rating_x10") < HIGH_RATING_X10) & (F.col("price_cents") > 0)
    out = df.agg(_mean_if(hi, "price_cents").alias("high_price_mean_cents"),
                 _mean_if(lo, "price_cents").alias("low_price_mean_cents"))
    return out.withColumn("difference_cents",
                          F.col("high_price_mean_cents") - F.col("low_price_mean_cents"))


def positive_reviews_q75(df: DataFrame) -> Column:
    """q75 of positive review counts (0 when none), as a scalar subquery."""
    q = df.where(F.col("reviews") > 0).agg(
        zero_if_null(F.percentile("reviews", F.lit(0.75))).alias("q"))
    return q.scalar()


def top_reviewed_vs_rest(df: DataFrame) -> DataFrame:
    """AG-23: listings with reviews >= q75 (of positive reviews) vs the rest:
    sales mean & median (sales > 0) and mean price (price > 0)."""
    q75 = positive_reviews_q75(df)
    top, rest = F.col("reviews") >= q75, F.col("reviews") < q75
    s, p = F.col("sales") > 0, F.col("price_cents") > 0
    out = df.agg(_mean_if(top & s, "sales").alias("top_sales_mean"),
                 _mean_if(rest & s, "sales").alias("rest_sales_mean"),
                 _median_if(top & s, "sales").alias("top_sales_median"),
                 _median_if(rest & s, "sales").alias("rest_sales_median"),
                 _mean_if(top & p, "price_cents").alias("top_price_mean_cents"),
                 _mean_if(rest & p, "price_cents").alias("rest_price_mean_cents"))
    return out.withColumn("reviews_q75", q75)


def _group_measures(df: DataFrame, group: str, labels) -> DataFrame:
    s, p = F.col("sales") > 0, F.col("price_cents") > 0
    g = df.groupBy(group).agg(
        F.avg(F.when(s, F.col("sales"))).alias("sales_mean"),
        F.median(F.when(s, F.col("sales"))).alias("sales_median"),
        F.avg(F.when(p, F.col("price_cents"))).alias("price_mean_cents"),
        F.count_if(s).alias("sales_count"), F.count_if(p).alias("price_count"))
    return complete_bins(g, group, labels, {"sales_mean": 0.0, "sales_median": 0.0,
                                            "price_mean_cents": 0.0, "sales_count": 0,
                                            "price_count": 0})


def by_rating_group(df: DataFrame) -> DataFrame:
    """AG-24: sales and price by rating group (FE-17), counts per measure."""
    return _group_measures(df.withColumn("rating_group", rating_group(F.col("rating_x10") / 10)),
                           "rating_group", RATING_GROUP_LABELS)


def with_review_quartile(df: DataFrame) -> DataFrame:
    """FE-18: review quartile bucket with thresholds over all rows (zeros included)."""
    q = df.agg(F.percentile("reviews", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q25, q50, q75 = (q.select(zero_if_null(F.col("q")[i])).scalar() for i in range(3))
    return df.withColumn("review_quartile", quartile_bucket("reviews", q25, q50, q75))


def by_review_quartile(df: DataFrame) -> DataFrame:
    """AG-25: sales and price by review quartile (FE-18)."""
    return _group_measures(with_review_quartile(df), "review_quartile", REVIEW_QUARTILE_LABELS)


def scatter_domain(df: DataFrame) -> DataFrame:
    """AG-26: log10 axis domain of reviews over rated (>= 1) listings with reviews."""
    v = df.where((F.col("rating_x10") >= 10) & (F.col("reviews") > 0))
    return v.agg(F.min("reviews").alias("reviews_min"), F.max("reviews").alias("reviews_max"),
                 F.floor(F.log10(F.min("reviews"))).alias("log_min"),
                 F.ceil(F.log10(F.max("reviews"))).alias("log_max"))
