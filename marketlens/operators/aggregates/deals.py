"""Discount questions (AG-12..AG-19) over ``plans.frames.deal_frame``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.bins import (DISCOUNT5_BIN_LABELS, DISCOUNT_BIN_LABELS,
                                       DISCOUNT_CLASS_LABELS, discount_bin5, discount_bin10,
                                       discount_class, label_of)
from marketlens.operators.aggregates.common import complete_bins, zero_if_null


NANO = 1_000_000_000


def mean_pct(c: str):
    """Mean of a percentage summed in integer nano-percent units: the sum is
    exact, so the mean does not depend on partitioning or summation order
    (each value is rounded at 1e-9 percentage points)."""
    nano = F.round(F.col(c) * NANO).cast("bigint")
    return F.sum(nano).cast("double") / F.count(nano) / NANO


def deal_kpis(df: DataFrame) -> DataFrame:
    """AG-12: mean discount % (zeros included), share discounted (%), price mean
    & median, total sales."""
    return df.agg(
        F.count(F.lit(1)).alias("listings"),
        zero_if_null(mean_pct("discount_pct")).alias("discount_mean_pct"),
        zero_if_null(F.avg((F.col("discount_pct") > 0).cast("int")) * 100).alias("discounted_pct"),
        zero_if_null(F.avg("price_cents")).alias("price_mean_cents"),
        zero_if_null(F.median("price_cents")).alias("price_median_cents"),
        F.coalesce(F.sum("sales"), F.lit(0)).cast("bigint").alias("sales_total"))


def discount_histogram(df: DataFrame) -> DataFrame:
    """AG-13: listings per 10-point discount bin, all ten bins."""
    g = (df.withColumn("discount_bin", discount_bin10("discount_pct"))
         .groupBy("discount_bin").agg(F.count(F.lit(1)).alias("listings")))
    return complete_bins(g, "discount_bin", DISCOUNT_BIN_LABELS, {"listings": 0})


def sales_by_discount(df: DataFrame) -> DataFrame:
    """AG-14: sales mean & median per discount bin over listings with sales."""
    g = (df.where(F.col("sales") > 0)
         .withColumn("discount_bin", discount_bin10("discount_pct"))
         .groupBy("discount_bin")
         .agg(F.count(F.lit(1)).alias("selling"), F.avg("sales").alias("sales_mean"),
              F.median("sales").alias("sales_median")))
    return complete_bins(g, "discount_bin", DISCOUNT_BIN_LABELS,
                         {"selling": 0, "sales_mean": 0.0, "sales_median": 0.0})


def discount_classes(df: DataFrame) -> DataFrame:
    """AG-15: listings per discount class (none, <=20, <=50, >50)."""
    g = (df.withColumn("discount_class", discount_class("discount_pct"))
         .groupBy("discount_class").agg(F.count(F.lit(1)).alias("listings")))
    return complete_bins(g, "discount_class", DISCOUNT_CLASS_LABELS, {"listings": 0})


def _by_category(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(mean_pct("discount_pct").alias("discount_mean_pct"),
                                      F.sum("sales").cast("bigint").alias("sales_total"))


def top_discount_categories(df: DataFrame, k: int = 5) -> DataFrame:
    """AG-16: the k categories with the deepest mean discount (ties by name)."""
    return _by_category(df).orderBy(F.col("discount_mean_pct").desc(), "category").limit(k)


def top_sales_categories(df: DataFrame, k: int = 5) -> DataFrame:
    """AG-17: the k categories with the largest total sales (ties by name)."""
    return _by_category(df).orderBy(F.col("sales_total").desc(), "category").limit(k)


def category_price_histogram(df: DataFrame, bins: int = 5) -> DataFrame:
    """AG-18: per category, equal-width price bins over positive prices.

    step = ceil(max / 5) dollars (1 when that is 0); bins [i*step, (i+1)*step).
    A maximum equal to 5*step falls outside every bin, as in the reference.
    Computed for every category at once: one grouped max, one grouped count.
    """
    pos = df.where(F.col("price_cents") > 0)
    step = (pos.groupBy("category")
            .agg(F.max("price_cents").alias("_max"))
            .select("category", F.greatest(
                F.expr(f"(_max + {bins * 100 - 1}) div {bins * 100}"), F.lit(1)).alias("step")))
    b = F.floor(F.col("price_cents") / (F.col("step") * 100)).cast("int") + 1
    counts = (pos.join(step, "category")
              .withColumn("bin", b).where(F.col("bin") <= bins)
              .groupBy("category", "bin").agg(F.count(F.lit(1)).alias("listings")))
    grid = step.select("category", "step",
                       F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return (grid.join(counts, ["category", "bin"], "left")
            .select("category", "bin",
                    ((F.col("bin") - 1) * F.col("step")).alias("bin_low"),
                    (F.col("bin") * F.col("step")).alias("bin_high"),
                    F.coalesce(F.col("listings"), F.lit(0)).alias("listings")))


def category_sales_by_discount(df: DataFrame) -> DataFrame:
    """AG-19: per category, mean positive sales per 20-point discount bin
    (all five bins, 0 when a bin has no sales)."""
    g = (df.where(F.col("sales") > 0)
         .withColumn("discount_bin", discount_bin5("discount_pct"))
         .groupBy("category", "discount_bin")
         .agg(F.count(F.lit(1)).alias("selling"), F.avg("sales").alias("sales_mean")))
    grid = (df.select("category").distinct()
            .select("category", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("discount_bin")))
    return (grid.join(g, ["category", "discount_bin"], "left")
            .select("category", "discount_bin",
                    label_of(F.col("discount_bin"), DISCOUNT5_BIN_LABELS).alias("discount_bin_label"),
                    F.coalesce(F.col("selling"), F.lit(0)).alias("selling"),
                    F.coalesce(F.col("sales_mean"), F.lit(0.0)).alias("sales_mean")))
