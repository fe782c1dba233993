"""Profiling questions (AG-38..AG-48)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import clean as C
from marketlens.operators.aggregates import profile as PR
from marketlens.plans import oracle as O
from marketlens.plans.catalog import register
from marketlens.plans.frames import listing_table, products
from marketlens.sources.fixtures import raw_listings

PRODUCT_COLS = ["asin", "row_k1", "row_k2", "row_k3", "title", "crawl_category", "price_cents",
                "original_price_cents", "rating_x10", "reviews", "sales_volume", "delivery_info",
                "is_amazon_choice", "is_prime", "has_variations", "is_climate_friendly",
                "number_of_offers", "variants", "key_features", "full_description"]
STRING_COLS = ["asin", "title", "crawl_category", "sales_volume", "delivery_info",
               "is_amazon_choice", "is_prime", "has_variations", "is_climate_friendly",
               "variants", "key_features", "full_description"]


def _ph_products_sql() -> str:
    cols = [f"{O.ph(c)} as {c}" if c in STRING_COLS else c for c in PRODUCT_COLS]
    return "ph_products as (select " + ", ".join(cols) + " from products)"


def _missing_sql(src: str, cols: list[str]) -> str:
    return f"""
select column_name, missing, missing * 100.0 / n as missing_pct from (
  select count(*) as n, {", ".join(f"count(*) - count({c}) as {c}" for c in cols)} from {src}
) unpivot (missing for column_name in ({", ".join(cols)}))"""


@register("ag_38", O.with_base(_missing_sql("ph_products", PRODUCT_COLS), _ph_products_sql()))
def ag_38(spark, d):
    df = C.replace_placeholders(products(spark, d))
    return PR.missing_profile(df).orderBy(F.col("missing").desc(), "column_name")


@register("ag_39", O.with_base(f"""
select count(*) as sparse_columns from ({_missing_sql("ph_products", PRODUCT_COLS)}) p
where missing_pct > 85""", _ph_products_sql()))
def ag_39(spark, d):
    df = C.replace_placeholders(products(spark, d))
    return PR.sparse_columns(df, 85.0, strict=True).agg(F.count(F.lit(1)).alias("sparse_columns"))


NULL_RATE_COLS = ["title", "price_cents", "rating_x10", "reviews", "sales_volume", "delivery_info"]


@register("ag_40", O.with_base(
    "select * from (select " + ", ".join(f"avg(cast({c} is null as int)) as {c}" for c in NULL_RATE_COLS)
    + " from raw_listings) unpivot (null_rate for column_name in (" + ", ".join(NULL_RATE_COLS) + "))"))
def ag_40(spark, d):
    return PR.null_rates(raw_listings(spark, d), NULL_RATE_COLS)


DESCRIBE_COLS = ["sales_volume_num", "price_cents", "rating_x10", "reviews", "discount_cents",
                 "number_of_offers"]


@register("ag_41", O.with_base(" union all ".join(f"""
select '{c}' as column_name, count({c}) as count, cast(sum({c}) as double) / count({c}) as mean,
  sqrt(cast(count({c}) * sum(cast({c} as hugeint) * {c}) - sum(cast({c} as hugeint)) * sum(cast({c} as hugeint)) as double)
       / cast(cast(count({c}) as hugeint) * (count({c}) - 1) as double)) as std,
  cast(min({c}) as bigint) as min, quantile_cont({c}, 0.25) as p25, quantile_cont({c}, 0.5) as p50,
  quantile_cont({c}, 0.75) as p75, cast(max({c}) as bigint) as max
from listing""" for c in DESCRIBE_COLS)))
def ag_41(spark, d):
    return PR.describe_integers(listing_table(spark, d), DESCRIBE_COLS)


BOOL_COLS = ["has_variations", "is_climate_friendly", "is_prime", "is_amazon_choice"]


@register("ag_42", O.with_base(" union all ".join(f"""
select '{c}' as column_name, count({c}) as count, count(distinct {c}) as unique,
  case when count({c}) > 0 then count(*) filter (where {c}) > count(*) filter (where not {c}) end as top,
  case when count({c}) > 0 then greatest(count(*) filter (where {c}), count(*) filter (where not {c})) end as freq
from listing""" for c in BOOL_COLS)))
def ag_42(spark, d):
    return PR.describe_boolean(listing_table(spark, d), BOOL_COLS)


@register("ag_43", O.with_base("""
with g as (select crawl_category, count(*) as listings from listing
           where crawl_category is not null group by 1)
select crawl_category, listings, (select count(*) from g) as distinct_values,
  crawl_category = (select crawl_category from g order by listings desc, crawl_category limit 1) as is_top
from g"""))
def ag_43(spark, d):
    return PR.value_counts(listing_table(spark, d), "crawl_category")


@register("ag_44", O.with_base("""
with st as (select min(price_cents) as lo, max(price_cents) as hi from listing),
b as (select case when hi = lo then 0 else least(cast(floor((price_cents - lo) * 40 / (hi - lo)) as int), 39) end as bin,
             count(*) as n from listing, st where price_cents is not null group by 1)
select r.bin, lo + (hi - lo) * r.bin / 40 as bin_start, lo + (hi - lo) * (r.bin + 1) / 40 as bin_end,
       cast(coalesce(b.n, 0) as bigint) as count
from (select cast(range as int) as bin from range(0, 40)) r cross join st left join b using (bin)"""))
def ag_44(spark, d):
    return PR.histogram(listing_table(spark, d), "price_cents", 40)


@register("ag_45", O.with_base("""
with st as (select count(*) as n, stddev_samp(v) * power(count(*), -0.2) as bw, min(v) as lo, max(v) as hi
            from (select sales_volume_num::double as v from listing where sales_volume_num is not null)),
     w as (select sales_volume_num::double as v, count(*) as w from listing where sales_volume_num is not null group by 1),
     g as (select i::int as i, lo - 3 * bw + ((hi + bw * 3) - (lo - 3 * bw)) / 199 * i as x, bw, n from st, range(200) r(i))
select i, x, sum(w * exp(-0.5 * ((x - v) / bw) * ((x - v) / bw)) / (bw * sqrt(2 * pi()))) / any_value(n) as density
from g, w group by i, x"""))
def ag_45(spark, d):
    return PR.density_curve(listing_table(spark, d), "sales_volume_num")


@register("ag_46", O.with_base("""
with q as (select quantile_cont(sales_volume_num, 0.25) as q1, quantile_cont(sales_volume_num, 0.5) as med,
                  quantile_cont(sales_volume_num, 0.75) as q3 from listing)
select q1, med as median, q3, q3 - q1 as iqr,
  min(cast(sales_volume_num as double)) filter (where sales_volume_num >= q1 - 1.5 * (q3 - q1)) as whisker_low,
  max(cast(sales_volume_num as double)) filter (where sales_volume_num <= q3 + 1.5 * (q3 - q1)) as whisker_high,
  count(*) filter (where sales_volume_num < q1 - 1.5 * (q3 - q1) or sales_volume_num > q3 + 1.5 * (q3 - q1)) as outliers
from listing, q group by q1, med, q3"""))
def ag_46(spark, d):
    return PR.box_stats(listing_table(spark, d), "sales_volume_num")


@register("ag_47", O.with_base("""
select count(*) as rows,
  count(*) - (select count(*) from (select distinct * from raw_listings)) as duplicate_rows,
  count(*) - (select count(*) from (select distinct asin from raw_listings)) as duplicate_keys
from raw_listings"""))
def ag_47(spark, d):
    return PR.duplicate_counts(raw_listings(spark, d), "asin")


@register("ag_48", O.with_base(
    "select column_name, non_null, rows, 20 as columns from (select count(*) as rows, "
    + ", ".join(f"count({c}) as {c}" for c in PRODUCT_COLS)
    + " from products) unpivot (non_null for column_name in (" + ", ".join(PRODUCT_COLS) + "))"))
def ag_48(spark, d):
    return PR.shape_info(products(spark, d))
