"""Scalar feature and filter questions (FE-01..FE-29, FLT-01..FLT-07).

Each returns one row per product with the computed expression, so the
oracle compares every value, not just an aggregate.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import bins, parse
from marketlens.functions import text as TX
from marketlens.operators import filters as FL
from marketlens.operators.joins import category_display
from marketlens.plans import oracle as O
from marketlens.plans.catalog import register
from marketlens.plans.frames import (build_listing_table, QUALITY_FIELDS, badge_frame, deal_frame, listing_table,
                                     market_frame, price_frame, products, quality_frame,
                                     trust_frame)


@register("fe_01", O.with_base(
    f"select asin, sales_volume, {O.sales_trunc('sales_volume')} as sales_num from products"))
def fe_01(spark, d):
    return products(spark, d).select(
        "asin", "sales_volume", parse.sales_number_truncated("sales_volume").alias("sales_num"))


@register("fe_02", O.with_base(
    f"select asin, sales_volume, {O.sales_round('sales_volume')} as sales_num from products"))
def fe_02(spark, d):
    return products(spark, d).select(
        "asin", "sales_volume", parse.sales_number_rounded("sales_volume").alias("sales_num"))


@register("fe_03", O.with_base(
    f"select asin, {O.fee_lenient('delivery_info')} as delivery_fee from products"))
def fe_03(spark, d):
    return products(spark, d).select(
        "asin", parse.delivery_fee_lenient("delivery_info").alias("delivery_fee"))


@register("fe_04", O.with_base(
    f"select asin, {O.fee_strict('delivery_info')} as delivery_fee from products"))
def fe_04(spark, d):
    return products(spark, d).select(
        "asin", parse.delivery_fee_strict("delivery_info").alias("delivery_fee"))


@register("fe_05", O.with_base("""
select asin, delivery_info, delivery_fee, delivery_date_text, delivery_ship_to, delivery_stock_note
from listing"""))
def fe_05(spark, d):
    return build_listing_table(spark, d).select(
        "asin", "delivery_info", "delivery_fee", "delivery_date_text", "delivery_ship_to",
        "delivery_stock_note")


@register("fe_06", O.with_base("select asin, discount_cents from listing"))
def fe_06(spark, d):
    return build_listing_table(spark, d).select("asin", "discount_cents")


@register("fe_07", O.with_base("select asin, discount_rate from listing"))
def fe_07(spark, d):
    return build_listing_table(spark, d).select("asin", "discount_rate")


@register("fe_08", O.with_base("select asin, discount_pct from deal"))
def fe_08(spark, d):
    return deal_frame(listing_table(spark, d)).select("asin", "discount_pct")


@register("fe_09", O.with_base(
    f"select asin, crawl_category, {O.disp_raw('crawl_category')} as display_category from products"))
def fe_09(spark, d):
    return products(spark, d).select(
        "asin", "crawl_category",
        category_display(F.col("crawl_category"), fallback="raw").alias("display_category"))


@register("fe_10", O.with_base(
    f"select asin, crawl_category, {O.disp_other('crawl_category')} as display_category from products"))
def fe_10(spark, d):
    return products(spark, d).select(
        "asin", "crawl_category",
        category_display(F.col("crawl_category"), fallback="other").alias("display_category"))


@register("fe_11", O.with_base("select asin, price_cents, segment from price_rows"))
def fe_11(spark, d):
    return price_frame(listing_table(spark, d)).select("asin", "price_cents", "segment")


@register("fe_12", O.with_base("select asin, price_cents, price_tier from badge"))
def fe_12(spark, d):
    return badge_frame(listing_table(spark, d)).select("asin", "price_cents", "price_tier")


PRICE_BIN_CASE = """case when price_cents < 0 then null
  when price_cents >= 20000 then 10 when price_cents >= 10000 then 9
  when price_cents >= 7000 then 8 when price_cents >= 5000 then 7
  when price_cents >= 3000 then 6 when price_cents >= 2000 then 5
  when price_cents >= 1500 then 4 when price_cents >= 1000 then 3
  when price_cents >= 500 then 2 else 1 end"""


@register("fe_13", O.with_base(f"select asin, {PRICE_BIN_CASE} as price_bin from listing"))
def fe_13(spark, d):
    return listing_table(spark, d).select(
        "asin", bins.price_bin(F.col("price_cents") / 100).alias("price_bin"))


def _edge_case(col: str, edges: list[int]) -> str:
    """Left-closed bin index by explicit comparisons (no float division)."""
    parts = [f"when {col} >= {e} then {i + 1}" for i, e in reversed(list(enumerate(edges[:-1])))]
    return f"case when {col} < {edges[0]} or {col} >= {edges[-1]} then null {' '.join(parts)} end"


DISC10_CASE = _edge_case("discount_pct", [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 101])
DISC5_CASE = _edge_case("discount_pct", [0, 20, 40, 60, 80, 101])


@register("fe_14", O.with_base(f"select asin, {DISC10_CASE} as discount_bin from deal"))
def fe_14(spark, d):
    return deal_frame(listing_table(spark, d)).select(
        "asin", bins.discount_bin10("discount_pct").alias("discount_bin"))


@register("fe_15", O.with_base(f"select asin, {DISC5_CASE} as discount_bin from deal"))
def fe_15(spark, d):
    return deal_frame(listing_table(spark, d)).select(
        "asin", bins.discount_bin5("discount_pct").alias("discount_bin"))


RATING_BIN_CASE = """case when rating_x10 > 0 and rating_x10 <= 10 then 1
  when rating_x10 <= 20 then 2 when rating_x10 <= 30 then 3
  when rating_x10 <= 40 then 4 when rating_x10 <= 50 then 5 end"""


@register("fe_16", O.with_base(f"select asin, rating_x10, {RATING_BIN_CASE} as rating_bin from market"))
def fe_16(spark, d):
    m = market_frame(listing_table(spark, d))
    return m.select("asin", "rating_x10", bins.rating_bin(F.col("rating_x10") / 10).alias("rating_bin"))


RATING_GROUP_CASE = """case when rating_x10 < 35 then 1 when rating_x10 < 40 then 2
  when rating_x10 < 45 then 3 when rating_x10 < 48 then 4 else 5 end"""


@register("fe_17", O.with_base(f"select asin, {RATING_GROUP_CASE} as rating_group from trust"))
def fe_17(spark, d):
    t = trust_frame(listing_table(spark, d))
    return t.select("asin", bins.rating_group(F.col("rating_x10") / 10).alias("rating_group"))


REVIEW_Q_SQL = """
review_q as (select quantile_cont(reviews, 0.25) as q25, quantile_cont(reviews, 0.5) as q50,
                    quantile_cont(reviews, 0.75) as q75 from trust)"""


@register("fe_18", O.with_base("""
select asin, reviews, case when reviews >= q75 then 4 when reviews >= q50 then 3
                           when reviews >= q25 then 2 else 1 end as review_quartile
from trust, review_q""", REVIEW_Q_SQL))
def fe_18(spark, d):
    from marketlens.operators.aggregates.trust import with_review_quartile
    return with_review_quartile(trust_frame(listing_table(spark, d))).select(
        "asin", "reviews", "review_quartile")


@register("fe_19", O.with_base("""
select asin, case when discount_pct <= 0 then 1 when discount_pct <= 20 then 2
                  when discount_pct <= 50 then 3 else 4 end as discount_class
from deal"""))
def fe_19(spark, d):
    return deal_frame(listing_table(spark, d)).select(
        "asin", bins.discount_class("discount_pct").alias("discount_class"))


@register("fe_20", O.with_base(
    "select asin, " + ", ".join(f"has_{c}" for c in QUALITY_FIELDS) + " from quality"))
def fe_20(spark, d):
    return quality_frame(listing_table(spark, d)).select(
        "asin", *[f"has_{c}" for c in QUALITY_FIELDS])


@register("fe_21", O.with_base("select asin, missing_count from quality"))
def fe_21(spark, d):
    return quality_frame(listing_table(spark, d)).select("asin", "missing_count")


@register("fe_22", O.with_base(
    "select asin, ln(1 + sales_volume_num) as sales_log, ln(1 + reviews) as reviews_log from listing"))
def fe_22(spark, d):
    return listing_table(spark, d).select(
        "asin", F.log1p("sales_volume_num").alias("sales_log"), F.log1p("reviews").alias("reviews_log"))


@register("fe_23", O.with_base("""
select asin, sales_volume_num,
  cast(greatest(0, round_even(exp(ln(1 + sales_volume_num)) - 1, 0)) as bigint) as units
from listing"""))
def fe_23(spark, d):
    from marketlens.ml.scoring import back_transform
    return listing_table(spark, d).select(
        "asin", "sales_volume_num", back_transform(F.log1p("sales_volume_num")).alias("units"))


@register("fe_24", O.with_base("""
select asin, case when sales_volume_num > 200 then 'high' when sales_volume_num > 50 then 'stable'
                  else 'optimise' end as potential
from listing"""))
def fe_24(spark, d):
    return listing_table(spark, d).select(
        "asin", bins.potential_badge("sales_volume_num").alias("potential"))


@register("fe_25", O.with_base("""
select asin, log10(reviews) as reviews_log10, least(greatest(rating_x10 / 10, 2.5), 5.0) as rating_x,
  case when sales > 2000 then 3 when sales > 500 then 2 else 1 end as sales_level
from trust where rating_x10 >= 10 and reviews > 0"""))
def fe_25(spark, d):
    t = trust_frame(listing_table(spark, d)).where((F.col("rating_x10") >= 10) & (F.col("reviews") > 0))
    return t.select("asin", F.log10("reviews").alias("reviews_log10"),
                    F.least(F.greatest(F.col("rating_x10") / 10, F.lit(2.5)), F.lit(5.0)).alias("rating_x"),
                    bins.sales_level("sales").alias("sales_level"))


@register("fe_26", O.with_base("""
select asin, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'),
  '^-+|-+$', '', 'g'), 1, 64), ''), 'all') as slug from listing"""))
def fe_26(spark, d):
    return listing_table(spark, d).select("asin", TX.slug("title").alias("slug"))


# Display names of the judged listing fields.
FIELD_NAMES = {
    "title": "Product title", "price_cents": "Current price",
    "original_price_cents": "List price", "rating": "Rating", "reviews": "Review count",
    "has_variations": "Has variations", "is_climate_friendly": "Climate pledge friendly",
    "number_of_offers": "Number of sellers", "variants": "Variant details",
    "key_features": "Key features", "full_description": "Full description",
}


@register("fe_27", O.with_base("""
select field, coalesce(n.field_name, field) as field_name, provided from (
  select * from (select """ + ", ".join(f"count(*) filter (where has_{c}) as {c}" for c in QUALITY_FIELDS)
    + """ from quality) unpivot (provided for field in (""" + ", ".join(QUALITY_FIELDS) + """))
) p left join (values """ + ", ".join(
        f"({O._q(k)}, {O._q(v)})" for k, v in FIELD_NAMES.items() if k != "variants") + """)
  as n(f, field_name) on n.f = p.field"""))
def fe_27(spark, d):
    from marketlens.operators.aggregates.quality import field_display_names
    names = {k: v for k, v in FIELD_NAMES.items() if k != "variants"}   # one unmapped -> raw
    q = quality_frame(listing_table(spark, d))
    counts = q.agg(*[F.count_if(f"has_{c}").alias(c) for c in QUALITY_FIELDS])
    long = counts.unpivot([], QUALITY_FIELDS, "field", "provided")
    return field_display_names(long, names)


@register("fe_28", O.with_base("""
select asin, case when length(title) > 20 then substr(title, 1, 20) || '...' else title end as label
from listing"""))
def fe_28(spark, d):
    return listing_table(spark, d).select("asin", TX.truncate_label("title", 20).alias("label"))


@register("fe_29", O.with_base("""
select asin, case when reviews >= 1000000
                  then cast(t6 // 10 as varchar) || '.' || cast(t6 % 10 as varchar) || 'M'
                  when reviews >= 1000
                  then cast(t3 // 10 as varchar) || '.' || cast(t3 % 10 as varchar) || 'K'
                  else cast(reviews as varchar) end as reviews_compact
from (select *, cast(floor(reviews / 100 + 0.5) as bigint) as t3,
                cast(floor(reviews / 100000 + 0.5) as bigint) as t6 from listing) l"""))
def fe_29(spark, d):
    return listing_table(spark, d).select("asin", TX.compact_number("reviews").alias("reviews_compact"))


# ---------------------------------------------------------------------------
# Filters
# ---------------------------------------------------------------------------

@register("flt_01", O.with_base("select asin, category from market where category = 'Department 21'"))
def flt_01(spark, d):
    rows = listing_table(spark, d).where(FL.shown_as("Department 21"))
    return market_frame(rows).select("asin", "category")


@register("flt_02", O.with_base("select asin from market where is_climate_friendly"))
def flt_02(spark, d):
    return FL.apply_filters(market_frame(listing_table(spark, d)), special="climate").select("asin")


@register("flt_03", O.with_base("select asin, category from deal where is_prime"))
def flt_03(spark, d):
    return FL.apply_filters(deal_frame(listing_table(spark, d)), prime_only=True) \
        .select("asin", "category")


@register("flt_04", O.with_base("select asin, price_cents from quality where segment = 1"))
def flt_04(spark, d):
    return FL.apply_filters(quality_frame(listing_table(spark, d)), segment=1) \
        .select("asin", "price_cents")


@register("flt_05", O.with_base("""
select asin, discount_pct from deal where discount_pct >= 20 and discount_pct < 30"""))
def flt_05(spark, d):
    return FL.apply_filters(deal_frame(listing_table(spark, d)), discount_range=(20, 30)) \
        .select("asin", "discount_pct")


@register("flt_06", O.with_base("""
select count(*) filter (where price_cents > 0) as priced, count(*) filter (where sales > 0) as selling,
       count(*) filter (where reviews > 0) as reviewed, count(*) filter (where rating_x10 >= 10) as rated
from trust"""))
def flt_06(spark, d):
    t = trust_frame(listing_table(spark, d))
    return t.agg(F.count_if(FL.positive("price_cents")).alias("priced"),
                 F.count_if(FL.positive("sales")).alias("selling"),
                 F.count_if(FL.positive("reviews")).alias("reviewed"),
                 F.count_if(F.col("rating_x10") >= 10).alias("rated"))


@register("flt_07", O.with_base("select asin, price_cents, sales from price_rows "
                                "where sales > 0 and price_cents <= 20000"))
def flt_07(spark, d):
    return FL.scatter_points(price_frame(listing_table(spark, d))).select("asin", "price_cents", "sales")
