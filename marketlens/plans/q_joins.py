"""Join questions (J-01..J-08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import joins as J
from marketlens.operators import ranking as R
from marketlens.plans import oracle as O
from marketlens.plans.catalog import register
from marketlens.plans.frames import listing_table, market_frame, price_frame, price_thresholds, quality_frame
from marketlens.sources import crawl
from marketlens.sources.fixtures import category_mapping

REVIEW_DDL = "struct<title:string,rating:double>"

CRAWL_SQL = """
search as (
  select asin, row_k1, row_k2, row_k3, title, price_cents, '/dp/' || asin as link,
         original_price_cents, rating_x10, reviews, delivery_info, sales_volume, is_amazon_choice, is_prime, has_variations,
         case when row_k3 % 13 <> 0 then 'USD' end as currency, case when row_k1 % 11 = 0 then 'True' else 'False' end as is_best_seller,
         number_of_offers, price_cents - row_k2 as lowest_offer_price_cents, is_climate_friendly,
         case when row_k3 % 9 = 0 then '' else '/img/' || asin || '.jpg' end as image_url
  from raw_listings
),
details as (
  select asin,
    case when reviews % 7 = 0 then '' else upper(title) end as title,
    case when reviews % 10 = 0 then null else price_cents end as price_cents,
    case when reviews % 4 = 0 then null else price_cents end as current_price_cents,
    case when reviews % 5 = 0 then '' else '/dp/' || asin end as link,
    cast(null as varchar) as image_url,
    case when reviews % 6 <> 0 then original_price_cents end as original_price_cents,
    case when reviews % 8 <> 0 then rating_x10 end as rating_x10,
    case when reviews % 9 <> 0 then reviews + 1 end as reviews,
    case when reviews % 3 <> 0 then upper(delivery_info) end as delivery_info,
    case when reviews % 2 <> 0 then upper(sales_volume) end as sales_volume,
    case when reviews % 4 <> 0 then 'true' end as is_amazon_choice,
    case when reviews % 4 <> 1 then 'false' end as is_prime,
    case when reviews % 7 <> 3 then has_variations end as has_variations,
    case when reviews % 5 <> 0 then 'EUR' end as currency,
    case when reviews % 6 <> 1 then 'true' end as is_best_seller,
    case when reviews % 7 <> 2 then number_of_offers + 1 end as number_of_offers,
    case when reviews % 9 <> 4 then price_cents - 1 end as lowest_offer_price_cents,
    case when reviews % 4 <> 3 then '1' end as is_climate_friendly
  from products where rating_x10 is not null
),
det_rev as (
  select asin, count(*) as n, min_by('review ' || row_k1 || '-' || row_k2, rn) as first_title from (
    select *, row_number() over (partition by asin order by row_k1, row_k2, row_k3) as rn
    from raw_listings where row_k3 % 3 = 0) x group by asin
),
end_rev as (
  select asin, count(*) as n, min_by('review ' || row_k1 || '-' || row_k2, rn) as first_title from (
    select *, row_number() over (partition by asin order by row_k1, row_k2, row_k3) as rn
    from raw_listings where row_k3 % 2 = 0) x group by asin
),
enriched as (
  select s.*, d.asin is not null as has_details, d.title as d_title, d.price_cents as d_price_cents,
         d.current_price_cents as d_current_price_cents, d.link as d_link, d.image_url as d_image_url,
         d.original_price_cents as d_original_price_cents, d.rating_x10 as d_rating_x10, d.reviews as d_reviews,
         d.delivery_info as d_delivery_info, d.sales_volume as d_sales_volume, d.is_amazon_choice as d_is_amazon_choice,
         d.is_prime as d_is_prime, d.has_variations as d_has_variations, d.currency as d_currency, d.is_best_seller as d_is_best_seller,
         d.number_of_offers as d_number_of_offers, d.lowest_offer_price_cents as d_lowest_offer_price_cents,
         d.is_climate_friendly as d_is_climate_friendly,
         dr.n as d_n, dr.first_title as d_first, er.n as e_n, er.first_title as e_first
  from search s left join details d using (asin)
  left join det_rev dr on dr.asin = d.asin
  left join end_rev er on er.asin = s.asin
)"""


def _enriched(spark, d):
    return J.enrich(crawl.search_items(spark, d), crawl.details(spark, d),
                    crawl.review_endpoint(spark, d))


@register("j_01", O.with_base(
    f"select asin, crawl_category, {O.disp_raw('crawl_category')} as display_category from listing"))
def j_01(spark, d):
    mapping = category_mapping()
    dim = J.dimension_frame(spark, mapping, "crawl_category", "display_category")
    lst = listing_table(spark, d).select("asin", "crawl_category")
    return J.lookup_join(lst, dim, "crawl_category", "display_category",
                         default=F.col("crawl_category"), dim_rows=len(mapping))


@register("j_02", O.with_base("""
select asin, row_k1, row_k2, row_k3, has_details, coalesce(d_n, 0) as detail_reviews,
       coalesce(e_n, 0) as endpoint_reviews from enriched""", CRAWL_SQL))
def j_02(spark, d):
    return _enriched(spark, d).select("asin", *crawl.ROW_KEY, F.col("_has_details").alias("has_details"),
                                      F.coalesce("d_top_reviews_n", F.lit(0)).alias("detail_reviews"),
                                      F.coalesce("e_reviews_list_n", F.lit(0)).alias("endpoint_reviews"))


MERGE_FIELDS = ["title", "price_cents", "link", "image_url", "original_price_cents", "rating_x10", "reviews", "delivery_info",
                "sales_volume", "is_amazon_choice", "is_prime", "has_variations", "currency", "is_best_seller", "number_of_offers",
                "lowest_offer_price_cents", "is_climate_friendly"]
_OTHERS = MERGE_FIELDS[4:]


@register("j_03", O.with_base("""
select asin, row_k1, row_k2, row_k3,
  """ + "".join(f"case when has_details then d_{c} else {c} end as {c}, " for c in _OTHERS) + """
  case when has_details then d_title else title end as title,
  case when has_details then d_price_cents else price_cents end as price_cents,
  case when has_details then d_link else link end as link,
  case when has_details then d_image_url else image_url end as image_url
from enriched""", CRAWL_SQL))
def j_03(spark, d):
    m = J.merge_details(_enriched(spark, d), MERGE_FIELDS)
    return m.select("asin", *crawl.ROW_KEY, *MERGE_FIELDS)


@register("j_04", O.with_base("""
select asin, row_k1, row_k2, row_k3, title, link, image_url, """ + ", ".join(_OTHERS) + """,
  coalesce(price_cents, current_price_cents) as price_cents,
  coalesce(current_price_cents, price_cents) as current_price_cents from (
  select asin, row_k1, row_k2, row_k3,
    case when has_details then d_has_variations else has_variations end as has_variations,
    """ + "".join(f"coalesce(case when has_details then d_{c} else {c} end, {c}) as {c}, " for c in _OTHERS if c != "has_variations") + """
    coalesce(nullif(case when has_details then d_title else title end, ''), title) as title,
    coalesce(nullif(case when has_details then d_link else link end, ''), link) as link,
    coalesce(nullif(case when has_details then d_image_url else image_url end, ''), image_url) as image_url,
    case when has_details then d_price_cents else price_cents end as price_cents,
    d_current_price_cents as current_price_cents
  from enriched) x""", CRAWL_SQL))
def j_04(spark, d):
    e = _enriched(spark, d)
    # keep the search values next to the record before details override them
    e = e.withColumns({f"s_{c}": F.col(c) for c in MERGE_FIELDS}) \
        .withColumn("current_price_cents", F.lit(None).cast("bigint"))
    m = J.merge_details(e, [*MERGE_FIELDS, "current_price_cents"])
    b = J.backfill_from_search(m, {c: f"s_{c}" for c in MERGE_FIELDS})
    return b.select("asin", *crawl.ROW_KEY, *MERGE_FIELDS, "current_price_cents")


@register("j_05", O.with_base("""
select asin, row_k1, row_k2, row_k3,
  case when coalesce(e_n, 0) > 0 then least(e_n, 3) else least(coalesce(d_n, 0), 3) end as reviews_kept,
  case when coalesce(e_n, 0) > 0 then e_first else d_first end as first_review
from enriched""", CRAWL_SQL))
def j_05(spark, d):
    e = _enriched(spark, d)
    kept = J.review_fallback("e_reviews_list", "d_top_reviews", REVIEW_DDL, 3)
    return e.select("asin", *crawl.ROW_KEY, F.size(kept).alias("reviews_kept"),
                    kept[0]["title"].alias("first_review"))


@register("j_06", O.with_base("""
select asin, sales from market where asin in (
  select asin from (
    select *, row_number() over (partition by category order by sales desc, row_k1, row_k2, row_k3, asin) as rn,
           count(*) over (partition by category) as n from market) m
  where rn <= greatest(1, floor(n * 0.1)))"""))
def j_06(spark, d):
    m = market_frame(listing_table(spark, d))
    top = R.top_fraction_exact(m, ["category"], "sales", ["row_k1", "row_k2", "row_k3", "asin"])
    return J.keep_rows_with_key(m, top.select("asin"), ["asin"]).select("asin", "sales")


@register("j_07", O.with_base("""
select case when grouping(category) = 1 then 'ALL' else category end as cell_category,
       case when grouping(segment) = 1 then 'ALL'
            else case segment when 1 then 'LOW' when 2 then 'MID' else 'HIGH' end end as cell_segment,
       count(*) as listings
from quality group by cube(category, segment)
having grouping(category) = 1 or category is not null"""))
def j_07(spark, d):
    from marketlens.operators.aggregates.quality import listings_by_cell
    return listings_by_cell(quality_frame(listing_table(spark, d)))


@register("j_08", O.with_base("""
select asin, price_cents, (select p33 from price_th) as p33_cents, (select p67 from price_th) as p67_cents
from price_rows"""))
def j_08(spark, d):
    p = price_frame(listing_table(spark, d))
    return J.attach_scalars(p.select("asin", "price_cents"), price_thresholds(p))
