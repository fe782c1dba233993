"""Ranking, sorting, set and sampling questions (W-01..04, SRT-01..04, SET-01..04, SP-01..04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import ranking as R
from marketlens.operators.clean import ROW_ORDER
from marketlens.plans import oracle as O
from marketlens.plans.catalog import register
from marketlens.plans.frames import listing_table, market_frame, products
from marketlens.sources.fixtures import raw_listings

TIE = ["row_k1", "row_k2", "row_k3", "asin"]


@register("w_01", O.with_base("select asin, row_k1, row_k2, row_k3, price_cents from products"))
def w_01(spark, d):
    return R.first_per_key(raw_listings(spark, d), "asin", ROW_ORDER) \
        .select("asin", "row_k1", "row_k2", "row_k3", "price_cents")


@register("w_02", O.with_base("""
select category, asin, sales from (
  select *, row_number() over (partition by category order by sales desc, row_k1, row_k2, row_k3, asin) as rn,
         count(*) over (partition by category) as n
  from market) m
where rn <= greatest(1, floor(n * 0.1))"""))
def w_02(spark, d):
    m = market_frame(listing_table(spark, d))
    return R.top_fraction_exact(m, ["category"], "sales", TIE, 0.1).select("category", "asin", "sales")


@register("w_03", O.with_base("""
select asin, price_cents, row_number() over (order by price_cents, row_k1, row_k2, row_k3, asin) as rank
from listing"""))
def w_03(spark, d):
    lst = listing_table(spark, d).select(*TIE, "price_cents")
    return R.global_ordinal_rank(lst, ["price_cents", *TIE], "rank").select("asin", "price_cents", "rank")


@register("w_04", O.with_base("""
select category, max(sales) as threshold from (
  select category, sales, row_number() over (partition by category order by sales desc) as rn,
         count(*) over (partition by category) as n from market) m
where rn = greatest(1, floor(n * 0.1)) group by category"""))
def w_04(spark, d):
    return R.kth_largest_threshold(market_frame(listing_table(spark, d)), ["category"], "sales", 0.1)


@register("srt_01", O.with_base("select asin, sales_volume_num from listing"))
def srt_01(spark, d):
    return listing_table(spark, d).select("asin", "sales_volume_num") \
        .orderBy(F.col("sales_volume_num").desc(), "asin")


@register("srt_02", O.with_base("""
select category, avg(sales) as sales_mean from market group by category
order by sales_mean desc, category limit 5"""))
def srt_02(spark, d):
    g = market_frame(listing_table(spark, d)).groupBy("category").agg(F.avg("sales").alias("sales_mean"))
    return R.top_k(g, 5, [F.col("sales_mean").desc(), "category"])


@register("srt_03", O.with_base("""
select asin, row_k1, row_k2, row_k3, crawl_category from (
  select *, row_number() over (partition by crawl_category order by row_k1, row_k2, row_k3, asin) as rn
  from (select * from raw_listings order by row_k1, row_k2, row_k3, asin limit 10000) c) x
where rn <= 100"""))
def srt_03(spark, d):
    raw = raw_listings(spark, d)
    capped = R.top_k(raw, 10_000, TIE)                       # crawl row target
    return R.per_group_cap(capped, ["crawl_category"], 100, TIE) \
        .select("asin", "row_k1", "row_k2", "row_k3", "crawl_category")


@register("srt_04", O.with_base("""
(select asin, 'head' as part from listing order by row_k1, row_k2, row_k3, asin limit 5)
union all
(select asin, 'tail' as part from listing order by row_k1 desc, row_k2 desc, row_k3 desc, asin desc limit 5)"""))
def srt_04(spark, d):
    lst = listing_table(spark, d)
    head = R.top_k(lst, 5, TIE).select("asin", F.lit("head").alias("part"))
    tail = R.top_k(lst, 5, [F.col(c).desc() for c in TIE]).select("asin", F.lit("tail").alias("part"))
    return head.unionByName(tail)


def _hash_sql(key: str = "asin", seed: int = 42) -> str:
    return f"cast('0x' || substr(md5({key} || ':{seed}'), 1, 8) as bigint)"


SPLIT_SQL = f"case when {_hash_sql()} % 100 < 70 then 'train' when {_hash_sql()} % 100 < 85 then 'val' else 'test' end"


@register("set_01", O.with_base(f"select asin, {SPLIT_SQL} as split from listing where {SPLIT_SQL} <> 'test'"))
def set_01(spark, d):
    split = R.hash_split(listing_table(spark, d), "asin")
    train = split.where("split = 'train'")
    val = split.where("split = 'val'")
    return train.unionByName(val).select("asin", "split")


@register("set_02", O.with_base("""
select 'search' as stage, crawl_category as category, row_k1 as page, 'missing sales text' as error,
       null as asin
from raw_listings where sales_volume is null
union all by name
select asin, 'missing rating' as error, crawl_category as category from products where rating_x10 is null"""))
def set_02(spark, d):
    raw = raw_listings(spark, d)
    search_err = raw.where(F.col("sales_volume").isNull()).select(
        F.lit("search").alias("stage"), F.col("crawl_category").alias("category"),
        F.col("row_k1").alias("page"), F.lit("missing sales text").alias("error"))
    enrich_err = products(spark, d).where(F.col("rating_x10").isNull()).select(
        "asin", F.lit("missing rating").alias("error"), F.col("crawl_category").alias("category"))
    return search_err.unionByName(enrich_err, allowMissingColumns=True)


@register("set_03", O.with_base(
    "select distinct category from market where category <> 'unknown' order by category"))
def set_03(spark, d):
    m = market_frame(listing_table(spark, d))
    return m.select("category").distinct().where(F.col("category") != "unknown").orderBy("category")


@register("set_04", O.with_base(
    "select distinct crawl_category from listing order by crawl_category limit 10"))
def set_04(spark, d):
    return listing_table(spark, d).select("crawl_category").distinct() \
        .orderBy("crawl_category").limit(10)


@register("sp_01", O.with_base(f"select {SPLIT_SQL} as split, count(*) as listings from listing group by 1"))
def sp_01(spark, d):
    return R.hash_split(listing_table(spark, d), "asin").groupBy("split") \
        .agg(F.count(F.lit(1)).alias("listings"))


@register("sp_02", O.with_base(f"select asin, title from products order by {_hash_sql()}, asin limit 1200"))
def sp_02(spark, d):
    return R.hash_sample(products(spark, d), "asin", 1200).select("asin", "title")


@register("sp_03", O.with_base(f"""
select asin, price_cents, sales_volume_num from listing where sales_volume_num > 0 and price_cents <= 20000
order by {_hash_sql()}, asin limit 500"""))
def sp_03(spark, d):
    pts = listing_table(spark, d).where((F.col("sales_volume_num") > 0) & (F.col("price_cents") <= 20000))
    return R.hash_sample(pts, "asin", 500).select("asin", "price_cents", "sales_volume_num")


@register("sp_04", O.with_base(f"select * from listing order by {_hash_sql()}, asin limit 10"))
def sp_04(spark, d):
    return R.hash_sample(listing_table(spark, d), "asin", 10)
