"""Landed crawl records derived from the driver tables (SRC-04, J-02..J-05 inputs).

The reference fetches search pages, product details and reviews over HTTP;
here those three record kinds are derived from the listing view so the
enrichment joins run on data that grows with the tables:

* search items: every raw listing row, tagged with its seed category/query;
* details: one record per product that has a rating (the "enriched" part),
  with a text title that is sometimes empty and prices that are sometimes
  present-but-null, to exercise merge precedence and backfill;
* review endpoint: reviews per product from its listing rows.

All reviews are counted; of the texts the first KEPT_REVIEWS are kept, the most that a
finished record holds. They are bounded *before* grouping (row_number, planned with a partial
WindowGroupLimit), so no group collects more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.sources.fixtures import first_listings, raw_listings

# Fixed value: reviews that a record keeps.
KEPT_REVIEWS = 3
ROW_KEY = ["row_k1", "row_k2", "row_k3"]


def search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_listings(spark, sf_dir)
    return raw.select(
        "asin", *ROW_KEY, "title", "price_cents", "original_price_cents", "rating_x10", "reviews",
        "sales_volume", "delivery_info", "is_amazon_choice", "is_prime", "has_variations",
        "number_of_offers", "is_climate_friendly",
        F.when(F.col("row_k3") % 13 != 0, F.lit("USD")).alias("currency"),
        F.when(F.col("row_k1") % 11 == 0, "True").otherwise("False").alias("is_best_seller"),
        (F.col("price_cents") - F.col("row_k2")).cast("bigint").alias("lowest_offer_price_cents"),
        F.concat(F.lit("/dp/"), F.col("asin")).alias("link"),
        F.when(F.col("row_k3") % 9 == 0, F.lit("")).otherwise(
            F.concat(F.lit("/img/"), F.col("asin"), F.lit(".jpg"))).alias("image_url"),
        F.col("crawl_category").alias("_seed_category"),
        F.replace(F.col("crawl_category"), F.lit("_"), F.lit(" ")).alias("_seed_query"))


def _reviews(raw: DataFrame, cond, name: str, keep: int = KEPT_REVIEWS) -> DataFrame:
    """asin, ``name`` (the first ``keep`` reviews) and ``name``_n (how many there are)."""
    w = Window.partitionBy("asin").orderBy(*ROW_KEY)
    r = (raw.where(cond).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep)
         .select("asin", "_rn", F.struct(
             F.concat(F.lit("review "), F.col("row_k1").cast("string"), F.lit("-"),
                      F.col("row_k2").cast("string")).alias("title"),
             (F.col("rating_x10") / 10).alias("rating")).alias("r")))
    first = r.groupBy("asin").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "r"))), lambda x: x["r"]).alias(name))
    return first.join(raw.where(cond).groupBy("asin").agg(F.count(F.lit(1)).alias(f"{name}_n")), "asin")


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_listings(spark, sf_dir)
    # first row per product, deduplicated on the narrow line-item keys
    prod = first_listings(spark, sf_dir).where(F.col("rating_x10").isNotNull())
    rev = _reviews(raw, F.col("row_k3") % 3 == 0, "top_reviews")
    return prod.select(
        "asin",
        F.when(F.col("reviews") % 7 == 0, F.lit("")).otherwise(F.upper("title")).alias("title"),
        F.when(F.col("reviews") % 10 == 0, F.lit(None).cast("bigint"))
        .otherwise(F.col("price_cents")).alias("price_cents"),
        F.when(F.col("reviews") % 4 == 0, F.lit(None).cast("bigint"))
        .otherwise(F.col("price_cents")).alias("current_price_cents"),
        F.when(F.col("reviews") % 5 == 0, F.lit("")).otherwise(
            F.concat(F.lit("/dp/"), F.col("asin"))).alias("link"),
        F.lit(None).cast("string").alias("image_url"),
        F.when(F.col("reviews") % 6 != 0, F.col("original_price_cents")).alias("original_price_cents"),
        F.when(F.col("reviews") % 8 != 0, F.col("rating_x10")).alias("rating_x10"),
        F.when(F.col("reviews") % 9 != 0, F.col("reviews") + 1).alias("reviews"),
        F.when(F.col("reviews") % 3 != 0, F.upper("delivery_info")).alias("delivery_info"),
        F.when(F.col("reviews") % 2 != 0, F.upper("sales_volume")).alias("sales_volume"),
        F.when(F.col("reviews") % 4 != 0, F.lit("true")).alias("is_amazon_choice"),
        F.when(F.col("reviews") % 4 != 1, F.lit("false")).alias("is_prime"),
        F.when(F.col("reviews") % 7 != 3, F.col("has_variations")).alias("has_variations"),
        F.when(F.col("reviews") % 5 != 0, F.lit("EUR")).alias("currency"),
        F.when(F.col("reviews") % 6 != 1, F.lit("true")).alias("is_best_seller"),
        F.when(F.col("reviews") % 7 != 2, F.col("number_of_offers") + 1).alias("number_of_offers"),
        F.when(F.col("reviews") % 9 != 4, F.col("price_cents") - 1).alias("lowest_offer_price_cents"),
        F.when(F.col("reviews") % 4 != 3, F.lit("1")).alias("is_climate_friendly"),
    ).join(rev, "asin", "left")


def review_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_listings(spark, sf_dir)
    return _reviews(raw, F.col("row_k3") % 2 == 0, "reviews_list")
