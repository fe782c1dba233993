"""Snapshot landing stream: landed CSV snapshots become cleaned rows."""

import os
import tempfile

from pyspark.sql import functions as F

from marketlens.sources.fixtures import raw_listings
from marketlens.streaming.ingest import start_snapshot_ingest

RAW_SCHEMA = ("asin string, row_k1 bigint, row_k2 int, row_k3 bigint, title string, "
              "crawl_category string, price_cents bigint, original_price_cents bigint, "
              "rating_x10 bigint, reviews bigint, sales_volume string, delivery_info string, "
              "is_amazon_choice string, is_prime string, has_variations string, "
              "is_climate_friendly string, number_of_offers bigint, variants string, "
              "key_features string, full_description string")


def test_snapshot_stream(spark):
    base = tempfile.mkdtemp(prefix="ml-stream-")
    landing = os.path.join(base, "landing")
    raw = raw_listings(spark, "/root/testdata/sf0.001")
    (raw.coalesce(1).write.option("header", True).option("escape", '"')
     .csv(os.path.join(base, "staging")))
    os.makedirs(landing)
    src = [f for f in os.listdir(os.path.join(base, "staging")) if f.endswith(".csv")][0]
    os.rename(os.path.join(base, "staging", src),
              os.path.join(landing, "amazon_products_viz_20260324_231228.csv"))
    q = start_snapshot_ingest(spark, landing, RAW_SCHEMA, os.path.join(base, "table"),
                              os.path.join(base, "ckpt"), trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(base, "table"))
    from marketlens.operators.clean import dashboard_table
    # the same rows the batch clean keeps, with the date from the file name
    assert sorted(r.asin for r in out.select("asin").collect()) == \
        sorted(r.asin for r in dashboard_table(raw).select("asin").collect())
    assert out.select(F.col("snapshot_date").cast("string")).distinct().collect()[0][0] == "2026-03-24"
    # the same batch again, as after a failure between its write and its commit: no row twice
    rows = out.count()
    q = start_snapshot_ingest(spark, landing, RAW_SCHEMA, os.path.join(base, "table"),
                              os.path.join(base, "ckpt-lost"), trigger_once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(os.path.join(base, "table")).count() == rows > 0
