"""Per-question prepared frames over the cleaned listing table.

Each dashboard question starts from the same cleaned table and adds its own
coercions (the reference's per-tab ``_prep``). All of it is projection and
filtering, fused into the scan's codegen stage; only thresholds that are
genuine global statistics (price quantiles) run as scalar subqueries,
computed once and inlined as literals.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import bins
from marketlens.operators.clean import ROW_ORDER, dashboard_table
from marketlens.operators.joins import category_display
from marketlens.session import ensure_checkpoint_dir
from marketlens.sources.fixtures import first_listings, raw_listings

# Labels for a missing category and for unmapped ones (FE-10).
UNKNOWN_CATEGORY = "unknown"
KEY = ["asin", "row_k1", "row_k2", "row_k3"]
OTHER_CATEGORY = "other"


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listing text, first row per product (W-01), before any cleaning.

    Same rows as ``first_per_key(raw_listings, 'asin', ROW_ORDER)`` (checked
    by the w_01 oracle and a test); the dedupe runs on the narrow keys first.
    """
    return first_listings(spark, sf_dir)


def build_listing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned, deduplicated listing table as a lazy plan over the raw tables."""
    return dashboard_table(products(spark, sf_dir), deduplicated=True)


_SNAPSHOTS: dict[tuple, str] = {}
_SNAPSHOT_LOCK = threading.Lock()


def input_stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, length and time of every input file, from the file system that holds them."""
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for t in ("lineitem", "part"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def listing_table(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """The cleaned listing table the dashboard questions read.

    Like the reference (clean once, write the snapshot, let every dashboard
    question load it), the table is built once per input and written as
    Parquet under the session's shared checkpoint folder; questions then scan
    that snapshot. This cuts the lineage (a lost executor re-reads the
    snapshot instead of re-running join + dedupe + parsing) and keeps every
    question's plan shallow. ``materialize=False`` returns the lazy plan.
    """
    if not materialize:
        return build_listing_table(spark, sf_dir)
    key = (spark.sparkContext.applicationId, input_stamp(spark, sf_dir))
    with _SNAPSHOT_LOCK:
        path = _SNAPSHOTS.get(key)
        if path is None:
            base = ensure_checkpoint_dir(spark).rstrip("/")
            path = f"{base}/listing_snapshot/{uuid.uuid4().hex}"
            build_listing_table(spark, sf_dir).write.mode("overwrite").parquet(path)
            _SNAPSHOTS[key] = path
    return spark.read.parquet(path)


def _z(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def market_frame(df: DataFrame) -> DataFrame:
    """Market overview rows: display category (raw fallback), zero-filled measures."""
    cat = F.coalesce(F.col("crawl_category"), F.lit(UNKNOWN_CATEGORY))
    return df.select(
        *KEY,
        category_display(cat, fallback="raw").alias("category"),
        _z("price_cents").alias("price_cents"),
        F.coalesce(F.col("rating_x10"), F.lit(0)).alias("rating_x10"),
        _z("reviews").alias("reviews"),
        _z("sales_volume_num").alias("sales"),
        *[F.coalesce(F.col(c), F.lit(False)).alias(c)
          for c in ("is_amazon_choice", "is_climate_friendly", "has_variations")])


def price_thresholds(df: DataFrame) -> DataFrame:
    """FE-11 thresholds as a one-row frame: p33/p67 of positive prices (cents,
    half-even rounded like the reference's 2-dp dollars), defaults 20/70."""
    pos = df.where(F.col("price_cents") > 0)
    q = F.percentile(F.col("price_cents"), F.array(F.lit(0.33), F.lit(0.67)))
    return pos.agg(q.alias("q")).select(
        F.coalesce(F.bround(F.col("q")[0], 0), F.lit(2000.0)).cast("bigint").alias("p33_cents"),
        F.coalesce(F.bround(F.col("q")[1], 0), F.lit(7000.0)).cast("bigint").alias("p67_cents"))


def price_frame(df: DataFrame) -> DataFrame:
    """Price-strategy rows: positive prices only, display category, segment."""
    base = df.select(
        *KEY,
        _z("price_cents").alias("price_cents"),
        _z("sales_volume_num").alias("sales"),
        category_display(F.col("crawl_category"), fallback="raw").alias("category"),
    ).where(F.col("price_cents") > 0)
    th = price_thresholds(base)
    p33 = th.select("p33_cents").scalar()
    p67 = th.select("p67_cents").scalar()
    return base.withColumn("segment", bins.segment("price_cents", p33, p67))


def deal_frame(df: DataFrame) -> DataFrame:
    """Deal rows: price, original (filled with price), percent rate clipped 0..100."""
    price = _z("price_cents")
    orig = F.coalesce(F.col("original_price_cents"), price)
    rate = F.when(orig > 0, (orig - price) * 100.0 / orig).otherwise(F.lit(0.0))
    return df.select(
        *KEY,
        category_display(F.coalesce(F.col("crawl_category"), F.lit(UNKNOWN_CATEGORY)),
                         fallback="raw").alias("category"),
        price.alias("price_cents"), orig.alias("original_price_cents"),
        F.least(F.greatest(rate, F.lit(0.0)), F.lit(100.0)).alias("discount_pct"),
        _z("sales_volume_num").alias("sales"),
        F.coalesce(F.col("is_prime"), F.lit(False)).alias("is_prime"))


def badge_frame(df: DataFrame) -> DataFrame:
    """Badge rows: 'other' category fallback, flags default false, price tier."""
    price = _z("price_cents")
    return df.select(
        *KEY,
        category_display(F.coalesce(F.col("crawl_category"), F.lit(UNKNOWN_CATEGORY)),
                         fallback="other").alias("category"),
        F.coalesce(F.col("is_amazon_choice"), F.lit(False)).alias("is_amazon_choice"),
        F.coalesce(F.col("is_best_seller"), F.lit(True)).alias("is_best_seller"),
        F.coalesce(F.col("is_prime"), F.lit(False)).alias("is_prime"),
        price.alias("price_cents"), _z("sales_volume_num").alias("sales"),
        F.coalesce(F.col("rating_x10"), F.lit(0)).alias("rating_x10"),
        _z("reviews").alias("reviews"),
        bins.price_tier(price, cents=True).alias("price_tier"))


# Listing fields judged for completeness (the reference's
# exclusion list applied to our table) and the quantitative ones among them.
QUALITY_FIELDS = ["title", "price_cents", "original_price_cents", "rating", "reviews",
                  "has_variations", "is_climate_friendly", "number_of_offers", "variants",
                  "key_features", "full_description"]
QUANTITATIVE_FIELDS = ["rating", "reviews", "number_of_offers"]


def quality_frame(df: DataFrame) -> DataFrame:
    """Listing-quality rows: provided flag per field, missing_count, segment
    (p33/p67 of positive prices, defaults $10/$30; zero prices fall in LOW)."""
    from marketlens.functions.text import is_missing
    price = _z("price_cents")
    provided = {f"has_{c}": ~is_missing(c, c in QUANTITATIVE_FIELDS) for c in QUALITY_FIELDS}
    missing = sum((~v).cast("int") for v in provided.values())
    base = df.select(
        *KEY,
        category_display(F.col("crawl_category"), fallback="raw").alias("category"),
        _z("sales_volume_num").alias("sales"), price.alias("price_cents"),
        *[v.alias(k) for k, v in provided.items()], missing.alias("missing_count"))
    pos = base.where(F.col("price_cents") > 0)
    q = pos.agg(F.percentile("price_cents", F.array(F.lit(0.33), F.lit(0.67))).alias("q"))
    p33 = q.select(F.coalesce(F.bround(F.col("q")[0], 0), F.lit(1000.0)).cast("bigint")).scalar()
    p67 = q.select(F.coalesce(F.bround(F.col("q")[1], 0), F.lit(3000.0)).cast("bigint")).scalar()
    return base.withColumn("segment", bins.segment("price_cents", p33, p67))


def trust_frame(df: DataFrame) -> DataFrame:
    """Rating/review rows: category with the 'other' fallback, zero-filled measures."""
    return df.select(
        *KEY,
        category_display(F.coalesce(F.col("crawl_category"), F.lit(UNKNOWN_CATEGORY)),
                         fallback="other").alias("category"),
        _z("price_cents").alias("price_cents"),
        F.coalesce(F.col("original_price_cents"), F.lit(0)).alias("original_price_cents"),
        F.coalesce(F.col("rating_x10"), F.lit(0)).alias("rating_x10"),
        _z("reviews").alias("reviews"),
        _z("sales_volume_num").alias("sales"))
