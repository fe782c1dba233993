"""Cleaning and validation questions (CLN-01..CLN-21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.ml.estimators import SparseColumnDropper
from marketlens.operators import clean as C
from marketlens.operators.aggregates.profile import missing_profile
from marketlens.operators.joins import attach_scalars
from marketlens.plans import oracle as O
from marketlens.plans.catalog import register
from marketlens.plans.frames import build_listing_table, listing_table, products

TEXT_COLS = ["sales_volume", "delivery_info", "variants", "key_features", "full_description"]
NUM_TEXT_COLS = ["is_climate_friendly", "sales_volume", "full_description", "variants"]
LISTING_COLS = ["asin", "row_k1", "row_k2", "row_k3", "title", "crawl_category", "price_cents",
                "original_price_cents", "rating_x10", "rating", "reviews", "sales_volume",
                "delivery_info", "is_amazon_choice", "is_prime", "has_variations",
                "is_climate_friendly", "number_of_offers", "variants", "key_features",
                "full_description", "date", "discount_cents", "discount_rate",
                "sales_volume_num", "delivery_fee", "delivery_date_text", "delivery_ship_to",
                "delivery_stock_note", "is_best_seller"]


def _tn(c: str) -> str:
    return f"case when isnan(try_cast({c} as double)) then null else try_cast({c} as double) end"


@register("cln_01", O.with_base(
    "select asin, " + ", ".join(f"{O.ph(c)} as {c}" for c in TEXT_COLS) + " from products"))
def cln_01(spark, d):
    return C.replace_placeholders(products(spark, d)).select("asin", *TEXT_COLS)


@register("cln_02", O.with_base(
    "select asin, " + ", ".join(f"{_tn(c)} as {c}" for c in NUM_TEXT_COLS) + " from products"))
def cln_02(spark, d):
    return C.coerce_numeric(products(spark, d), NUM_TEXT_COLS).select("asin", *NUM_TEXT_COLS)


@register("cln_03", O.with_base(
    "select " + ", ".join(f"count(*) filter (where {c} is not null and {_tn(c)} is null) as {c}"
                          for c in NUM_TEXT_COLS) + " from products"))
def cln_03(spark, d):
    return C.coercion_losses(products(spark, d), NUM_TEXT_COLS)


CENT_RULES = {
    "price_cents": lambda c: c < 0,
    "reviews": lambda c: c < 0,
    "rating": lambda c: (c < 1) | (c > 5),
}


@register("cln_04", O.with_base("""
select count(*) filter (where price_cents < 0) as price_cents,
       count(*) filter (where reviews < 0) as reviews,
       count(*) filter (where rating < 1 or rating > 5) as rating,
       count(*) filter (where not (rating < 1 or rating > 5)) as rating_kept
from listing"""))
def cln_04(spark, d):
    df = listing_table(spark, d)
    counts = C.range_violations(df, CENT_RULES)
    kept = C.apply_range_rules(df, CENT_RULES).agg(F.count("rating").alias("rating_kept"))
    return attach_scalars(counts, kept)


@register("cln_05", O.with_base(
    "select " + ", ".join(
        f"count(*) filter (where {c} is not null and ({O.booldom(c)}) is null) as {c}_invalid, "
        f"count(*) filter (where {O.booldom(c)}) as {c}_true"
        for c in C.BOOL_FLAGS) + " from products"))
def cln_05(spark, d):
    p = products(spark, d)
    bad = C.bool_domain_violations(p).select(*[F.col(c).alias(f"{c}_invalid") for c in C.BOOL_FLAGS])
    good = C.enforce_bool_domain(p).agg(*[F.count_if(F.col(c)).alias(f"{c}_true")
                                          for c in C.BOOL_FLAGS])
    return attach_scalars(bad, good)


@register("cln_06", O.with_base(
    "select asin, " + ", ".join(f"cast({c} as int) as {c}" for c in C.BOOL_FLAGS)
    + " from listing"))
def cln_06(spark, d):
    return C.bools_to_int(listing_table(spark, d)).select("asin", *C.BOOL_FLAGS)


FLAG_COLS = ["is_amazon_choice", "is_prime", "is_best_seller"]


@register("cln_07", O.with_base("""
select asin,
  coalesce(lower(trim(is_amazon_choice)) in ('true', '1', 'yes', 'y'), false) as is_amazon_choice,
  coalesce(lower(trim(is_prime)) in ('true', '1', 'yes', 'y'), false) as is_prime,
  false as is_best_seller
from products"""))
def cln_07(spark, d):
    return C.text_flags(products(spark, d), FLAG_COLS).select("asin", *FLAG_COLS)


INT_FLAG_COLS = ["is_climate_friendly", "has_variations", "is_best_seller"]


@register("cln_08", O.with_base("""
select asin,
  case when lower(trim(is_climate_friendly)) in ('true', '1', 'yes', 'y') then 1
       else coalesce(try_cast(lower(trim(is_climate_friendly)) as int), 0) end as is_climate_friendly,
  case when lower(trim(has_variations)) in ('true', '1', 'yes', 'y') then 1
       else coalesce(try_cast(lower(trim(has_variations)) as int), 0) end as has_variations,
  0 as is_best_seller
from products"""))
def cln_08(spark, d):
    return C.int_flags(products(spark, d), INT_FLAG_COLS).select("asin", *INT_FLAG_COLS)


@register("cln_09", O.with_base(f"""
select asin, coalesce(original_price_cents, price_cents) as original_price_cents,
  coalesce({O.ph('sales_volume')}, '0 bought in past month') as sales_volume,
  coalesce({O.ph('delivery_info')}, 'No delivery information') as delivery_info
from products"""))
def cln_09(spark, d):
    df = C.fill_missing(C.replace_placeholders(products(spark, d)),
                        {"original_price_cents": "price_cents"},
                        {"sales_volume": C.NO_SALES_TEXT, "delivery_info": C.NO_DELIVERY_TEXT})
    return df.select("asin", "original_price_cents", "sales_volume", "delivery_info")


@register("cln_10", O.with_base(
    "select asin from products where price_cents is not null and rating_x10 is not null"))
def cln_10(spark, d):
    return C.drop_incomplete(products(spark, d), ["price_cents", "rating_x10"]).select("asin")


_KEPT_AFTER_DROP = [c for c in LISTING_COLS if c not in C.UNNECESSARY_FEATURES]


@register("cln_11", O.with_base("select " + ", ".join(_KEPT_AFTER_DROP) + " from listing"))
def cln_11(spark, d):
    return C.drop_columns(listing_table(spark, d), C.UNNECESSARY_FEATURES)


_SPARSE_INPUT = ["asin", "title", "sales_volume", "delivery_info", "variants", "key_features", "full_description",
                 "original_price_cents", "rating_x10", "reviews", *C.BOOL_FLAGS]


# is_prime and is_climate_friendly hold no true or false in the fixture, so all of their values are missing
@register("cln_12", O.with_base("select " + ", ".join(
    f"{O.ph(c)} as {c}" if c in ("title", "sales_volume", "delivery_info", "variants", "key_features", "full_description")
    else f"{O.booldom(c)} as {c}" if c in ("is_amazon_choice", "has_variations") else c
    for c in _SPARSE_INPUT if c not in ("is_prime", "is_climate_friendly")) + " from products"))
def cln_12(spark, d):
    df = C.enforce_bool_domain(C.replace_placeholders(products(spark, d))).select(*_SPARSE_INPUT)
    return SparseColumnDropper().fit(df).transform(df)


@register("cln_13", O.with_base("""
select asin, greatest(price_cents, 0) as price_cents,
  least(greatest(discount_rate * 100, 0), 100) as discount_pct
from listing"""))
def cln_13(spark, d):
    df = listing_table(spark, d)
    return df.select("asin", C.clip("price_cents", lower=0).alias("price_cents"),
                     C.clip(F.col("discount_rate") * 100, 0, 100).alias("discount_pct"))


@register("cln_14", O.with_base(
    "select asin, reviews, number_of_offers, crawl_category from products"))
def cln_14(spark, d):
    renamed = (products(spark, d).withColumnRenamed("reviews", "review_count")
               .withColumnRenamed("number_of_offers", "offer_count")
               .withColumnRenamed("crawl_category", "category"))
    return C.apply_synonyms(renamed).select("asin", "reviews", "number_of_offers", "crawl_category")


CONFORM_SPEC = {
    "asin": ("string", None),
    "price_cents": ("bigint", 0),
    "reviews": ("bigint", 0),
    "number_of_offers": ("bigint", 0),
    "is_climate_friendly": ("boolean", False),
    "sales_volume": ("string", "0 bought in past month"),
    "unit_count": ("bigint", 0),
    "currency": ("string", "USD"),
}


@register("cln_15", O.with_base("""
select asin, coalesce(price_cents, 0) as price_cents, coalesce(reviews, 0) as reviews,
  coalesce(cast(number_of_offers as bigint), 0) as number_of_offers,
  coalesce(try_cast(is_climate_friendly as boolean), false) as is_climate_friendly,
  coalesce(sales_volume, '0 bought in past month') as sales_volume,
  cast(0 as bigint) as unit_count, 'USD' as currency
from products"""))
def cln_15(spark, d):
    return C.conform(products(spark, d), CONFORM_SPEC, keep_rest=False)


@register("cln_16", O.with_base("select * from listing"))
def cln_16(spark, d):
    return C.order_columns(listing_table(spark, d), ["asin", "title", "price_cents", "rating"])


_NUMERIC_LISTING = ["row_k1", "row_k2", "row_k3", "price_cents", "original_price_cents",
                    "rating_x10", "rating", "reviews", "number_of_offers", "discount_cents",
                    "discount_rate", "sales_volume_num", "delivery_fee"]


@register("cln_17", O.with_base("select " + ", ".join(_NUMERIC_LISTING) + " from listing"))
def cln_17(spark, d):
    return C.select_kind(listing_table(spark, d), "numeric")


@register("cln_18", O.with_base("select asin, date from listing"))
def cln_18(spark, d):
    return C.add_date(build_listing_table(spark, d).select("asin"), C.SNAPSHOT_DATE)


@register("cln_19", O.with_base("""
select asin,
  coalesce(case when json_valid(variants) then case when json_type(variants) = 'OBJECT'
                then len(json_keys(variants)) end end, 0) as variants_size,
  case when json_valid(variants) then case when json_type(variants) = 'OBJECT'
       then json_extract_string(variants, '$.color') end end as variant_color,
  coalesce(case when json_valid(key_features) then case when json_type(key_features) = 'ARRAY'
                then json_array_length(key_features) end end, 0) as key_features_size
from products"""))
def cln_19(spark, d):
    df = C.normalize_nested(products(spark, d), ["variants"], ["key_features"])
    return df.select("asin", F.size("variants").alias("variants_size"),
                     F.try_element_at("variants", F.lit("color")).alias("variant_color"),
                     F.size("key_features").alias("key_features_size"))


@register("cln_21", O.with_base("select * from cleaned"))
def cln_21(spark, d):
    from marketlens.sources.fixtures import raw_listings
    return C.dashboard_clean(raw_listings(spark, d))
