"""Source and sink questions (SRC-01..SRC-12): write to a fresh scratch folder
under the shared checkpoint directory, read back, return the re-read frame."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from marketlens.operators.aggregates import market as M
from marketlens.operators.ranking import hash_split
from marketlens.plans import oracle as O
from marketlens.plans.catalog import register
from marketlens.plans.frames import listing_table, market_frame, products
from marketlens.sources import io as IO
from marketlens.sources.fixtures import raw_listings

CSV_COLS = ["asin", "title", "crawl_category", "price_cents", "rating", "reviews", "sales_volume",
            "delivery_info", "is_prime", "date"]
CSV_SCHEMA = ("asin string, title string, crawl_category string, price_cents bigint, rating double, "
              "reviews bigint, sales_volume string, delivery_info string, is_prime boolean, date date")


@register("src_01", O.with_base("select " + ", ".join(CSV_COLS) + " from listing"))
def src_01(spark, d):
    path = IO.scratch_path(spark, "csv")
    IO.write_csv(listing_table(spark, d).select(*CSV_COLS), path)
    return IO.read_csv(spark, path, CSV_SCHEMA)


def _newest(spark, d):
    """Three snapshots with times of their own; the newest of the preferred names is read alone."""
    base = IO.scratch_path(spark, "snapshots")
    lst = listing_table(spark, d).select(*CSV_COLS)
    for name, rows, seconds in (("amazon_products_viz_20260320_080000", lst.where("rating < 4"), 1773993600),
                                ("amazon_products_viz_20260324_231228", lst, 1774393948),
                                ("amazon_products_modeling_20260325_000000", lst.where("rating >= 4"), 1774396800)):
        IO.write_csv(rows, f"{base}/{name}")
        IO.set_time(spark, f"{base}/{name}", seconds)
    path, name, seconds = IO.newest_snapshot(spark, base)
    return IO.with_snapshot(IO.read_csv(spark, path, CSV_SCHEMA), name, seconds)


@register("src_02", O.with_base("select " + ", ".join(CSV_COLS) + " from listing"))
def src_02(spark, d):
    return _newest(spark, d).select(*CSV_COLS)


@register("src_03", O.with_base("select asin, date '2026-03-24' as snapshot_date, '24/03/2026 23:12' as file_time from listing"))
def src_03(spark, d):
    return _newest(spark, d).select("asin", "snapshot_date", "file_time")


@register("src_04", O.with_base("""
select asin, row_k1, row_k2, row_k3, title, price_cents, crawl_category as _seed_category,
       replace(crawl_category, '_', ' ') as _seed_query from raw_listings"""))
def src_04(spark, d):
    raw = raw_listings(spark, d)
    item = F.struct("asin", "row_k1", "row_k2", "row_k3", "title", "price_cents")
    # pages group items by order-key range: bounded size, no window over a category
    pages = (raw.withColumn("page", F.floor(F.col("row_k1") / 1000))
             .groupBy("crawl_category", "page")
             .agg(F.collect_list(item).alias("results"))
             .select(F.col("crawl_category").alias("category"),
                     F.replace(F.col("crawl_category"), F.lit("_"), F.lit(" ")).alias("query"),
                     "page", "results"))
    path = IO.scratch_path(spark, "search-pages")
    IO.write_json_lines(pages, path)
    schema = ("category string, query string, page bigint, results array<struct<asin:string, "
              "row_k1:bigint, row_k2:int, row_k3:bigint, title:string, price_cents:bigint>>")
    landed = spark.read.schema(schema).json(path)
    return IO.landed_search_items(landed).drop("page")


@register("src_05", O.with_base(
    "select asin, delivery_fee, delivery_ship_to from listing"))
def src_05(spark, d):
    lst = listing_table(spark, d).select(
        "asin", F.struct("delivery_fee", "delivery_ship_to").alias("delivery"))
    path = IO.scratch_path(spark, "csv-complex")
    IO.write_csv(lst, path)
    back = IO.read_csv(spark, path, "asin string, delivery string")
    parsed = F.from_json("delivery", "delivery_fee double, delivery_ship_to string")
    return back.select("asin", parsed["delivery_fee"].alias("delivery_fee"),
                       parsed["delivery_ship_to"].alias("delivery_ship_to"))


@register("src_06", O.with_base("select asin, price_cents, date from listing"))
def src_06(spark, d):
    path = IO.scratch_path(spark, "parquet")
    IO.write_parquet(listing_table(spark, d).select("asin", "price_cents", "date"), path, ["date"])
    return spark.read.parquet(path).select("asin", "price_cents", F.col("date").cast("date"))


@register("src_07", O.with_base("select asin, delivery_date_text, delivery_stock_note from listing"))
def src_07(spark, d):
    path = IO.scratch_path(spark, "jsonl")
    IO.write_json_lines(listing_table(spark, d).select("asin", "delivery_date_text",
                                                       "delivery_stock_note"), path)
    return spark.read.schema("asin string, delivery_date_text string, delivery_stock_note string") \
        .json(path)


@register("src_08", O.with_base(
    "select asin, rating_x10 is not null as valid from products"))
def src_08(spark, d):
    ok_path, err_path = IO.scratch_path(spark, "valid"), IO.scratch_path(spark, "errors")
    p = products(spark, d).select("asin", "rating_x10")
    has_err = IO.write_with_errors(p, F.col("rating_x10").isNotNull(), ok_path, err_path)
    good = spark.read.parquet(ok_path).select("asin", F.lit(True).alias("valid"))
    if not has_err:
        return good
    return good.unionByName(spark.read.parquet(err_path).select("asin", F.lit(False).alias("valid")))


@register("src_09", O.with_base(
    "select asin, price_cents, 'US' as country, '20260324_231228' as ingest_ts from listing"))
def src_09(spark, d):
    path = IO.scratch_path(spark, "partitioned")
    df = listing_table(spark, d).select("asin", "price_cents", F.lit("US").alias("country"),
                                        F.lit("20260324_231228").alias("ingest_ts"))
    IO.write_parquet(df, path, ["country", "ingest_ts"])
    return spark.read.option("basePath", path).schema(
        "asin string, price_cents bigint, country string, ingest_ts string").parquet(path)


_SPLIT = "cast('0x' || substr(md5(asin || ':42'), 1, 8) as bigint) % 100"


@register("src_10", O.with_base(f"""
select asin, case when {_SPLIT} < 70 then 'train' when {_SPLIT} < 85 then 'val' else 'test' end as split,
       price_cents, reviews, ln(1 + sales_volume_num) as target_log from listing"""))
def src_10(spark, d):
    """Stored splits read back one by one, features apart from the target, by product."""
    path = IO.scratch_path(spark, "splits")
    df = listing_table(spark, d).select("asin", "price_cents", "reviews", F.log1p("sales_volume_num").alias("target_log"))
    IO.write_parquet(hash_split(df, "asin"), path, ["split"])
    parts = [IO.read_split(spark, path, name, "target_log") for name in ("train", "val", "test")]
    return functools.reduce(lambda a, b: a.unionByName(b), [x.join(y, ["asin", "split"]) for x, y in parts])


@register("src_11", O.with_base("""
select count(*) as listings, coalesce(avg(price_cents), 0.0) as price_mean_cents,
  coalesce(quantile_cont(price_cents, 0.5), 0.0) as price_median_cents,
  coalesce(avg(sales), 0.0) as sales_mean, coalesce(quantile_cont(sales, 0.5), 0.0) as sales_median,
  coalesce(avg(rating_x10) / 10, 0.0) as rating_mean,
  count(*) filter (where is_amazon_choice) as choice_listings,
  coalesce(avg(cast(is_amazon_choice as int)) * 100, 0.0) as choice_pct
from market"""))
def src_11(spark, d):
    m = IO.cached(market_frame(listing_table(spark, d)))
    return M.market_kpis(m)


EXPORT_COLS = ["category", "price_cents", "rating_x10", "reviews", "sales", "is_amazon_choice"]


@register("src_12", O.with_base(
    "select to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in EXPORT_COLS)
    + ")) as record from market"))
def src_12(spark, d):
    return IO.export_records(market_frame(listing_table(spark, d)), EXPORT_COLS)
