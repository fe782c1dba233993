"""Independent SQL statements of the same questions, for DuckDB.

These are the correctness oracle: written from the definitions, not from
the Spark code, over the same driver tables. Every statement starts from
the shared listing CTEs below.
"""

from __future__ import annotations

from marketlens.functions.parse import (DATE_PATTERN, DELIVERY_FEE_PATTERN, SALES_PATTERN,
                                        SHIP_PATTERN, STOCK_PATTERN)
from marketlens.functions.text import PLACEHOLDERS
from marketlens.sources.fixtures import category_mapping


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(vals) -> str:
    return "(" + ", ".join(_q(v) for v in vals) + ")"


RAW_LISTINGS = """
raw_listings as (
select
  'P' || lpad(cast(l_partkey as string), 8, '0') as asin,
  l_orderkey as row_k1, l_linenumber as row_k2, l_suppkey as row_k3,
  p_name as title,
  lower(replace(p_brand, '#', '_')) as crawl_category,
  price_cents,
  case when disc_pm = 0 then null else orig_cents end as original_price_cents,
  case when l_orderkey % 41 = 0 then null
       when l_orderkey % 97 = 0 then 0
       else 30 + (l_partkey * 7 + l_suppkey * 3) % 21 end as rating_x10,
  case when l_orderkey % 53 = 0 then null else (l_orderkey * 37 + l_partkey) % 9000 end as reviews,
  case when qty >= 40 then cast(qty - 38 as string) || 'K+ bought in past month'
       when qty >= 5  then cast(qty * 10 as string) || '+ bought in past month'
       when qty >= 3  then 'N/A'
       else null end as sales_volume,
  case when l_returnflag = 'R' then '$' || cast(5 + qty % 20 as string) || '.78 delivery Tue, Mar 31 Ships to VietnamOnly ' || cast(1 + qty % 9 as string) || ' left in stock'
       when l_returnflag = 'A' then 'FREE Delivery Mon, Apr 6 Ships to Vietnam'
       when qty % 2 = 0 then '[]'
       else null end as delivery_info,
  case when l_partkey % 14 = 0 then 'True' else 'False' end as is_amazon_choice,
  case when l_suppkey % 50 = 0 then 'yes' else 'no' end as is_prime,
  case when l_partkey % 6 = 0 then 'True' else 'False' end as has_variations,
  case when l_suppkey % 6 = 1 then '1' else '0' end as is_climate_friendly,
  1 + l_suppkey % 5 as number_of_offers,
  case when l_partkey % 3 = 0 then '{}' when l_partkey % 3 = 1 then '{"color": "red"}' else '' end as variants,
  case when l_partkey % 5 < 2 then 'bullet text' else '[]' end as key_features,
  case when (l_partkey + l_suppkey) % 4 = 0 then 'nan' else 'long text' end as full_description
from (
  select z.*, orig_cents - cast(floor(orig_cents * disc_pm * 9 / 1000.0) as bigint) as price_cents
  from (
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, p_name, p_brand,
           cast(l_quantity as bigint) as qty,
           cast(floor(l_discount * 1000 + 0.5) as bigint) as disc_pm,
           cast(floor(l_extendedprice / l_quantity * 2) as bigint) as orig_cents
    from lineitem join part on l_partkey = p_partkey
  ) z
) y
)"""

PRODUCTS = """
products as (
select * exclude (rn) from (
  select r.*, row_number() over (partition by asin order by row_k1, row_k2, row_k3) as rn
  from raw_listings r
) x where rn = 1
)"""


def ph(c: str) -> str:
    """Placeholder text -> NULL."""
    return f"case when {c} in {_in(PLACEHOLDERS)} then null else {c} end"


def booldom(c: str) -> str:
    t = f"lower(trim({ph(c)}))"
    return f"case when {t} = 'true' then true when {t} = 'false' then false end"


def sales_trunc(c: str) -> str:
    t = f"lower({c})"
    num = f"cast(nullif(regexp_extract({t}, {_q(SALES_PATTERN)}, 1), '') as double)"
    mult = f"case when regexp_extract({t}, {_q(SALES_PATTERN)}, 2) = 'k' then 1000 else 1 end"
    return f"coalesce(cast(trunc({num} * {mult}) as bigint), 0)"


def sales_round(c: str) -> str:
    num = f"cast(nullif(regexp_extract({c}, {_q(SALES_PATTERN)}, 1), '') as double)"
    mult = f"case when lower(regexp_extract({c}, {_q(SALES_PATTERN)}, 2)) = 'k' then 1000 else 1 end"
    return f"cast(round_even({num} * {mult}, 0) as bigint)"


def fee_lenient(c: str) -> str:
    return (f"coalesce(cast(nullif(regexp_extract({c}, {_q('(?i)' + DELIVERY_FEE_PATTERN)}, 1), '')"
            f" as double), 0.0)")


def fee_strict(c: str) -> str:
    return f"cast(nullif(regexp_extract({c}, {_q(DELIVERY_FEE_PATTERN)}, 1), '') as double)"


def delivery_part(c: str, pattern: str) -> str:
    norm = f"regexp_replace(trim({c}), '([0-9])([A-Za-z])', '\\1 \\2', 'g')"
    return f"nullif(trim(regexp_extract({norm}, {_q(pattern)}, 1)), '')"


def _none(c: str) -> str:
    return f"({c} is null or lower({c}) = 'no delivery information')"


CLEAN = f"""
cleaned as (
select asin, row_k1, row_k2, row_k3,
  {ph('title')} as title,
  {ph('crawl_category')} as crawl_category,
  greatest(price_cents, 0) as price_cents,
  coalesce(original_price_cents, price_cents) as original_price_cents,
  rating_x10, rating_x10 / 10 as rating, reviews,
  sv as sales_volume, di as delivery_info,
  {booldom('is_amazon_choice')} as is_amazon_choice,
  {booldom('is_prime')} as is_prime,
  {booldom('has_variations')} as has_variations,
  {booldom('is_climate_friendly')} as is_climate_friendly,
  number_of_offers,
  {ph('variants')} as variants,
  {ph('key_features')} as key_features,
  {ph('full_description')} as full_description,
  date '2026-03-24' as date,
  coalesce(original_price_cents, price_cents) - price_cents as discount_cents,
  case when coalesce(original_price_cents, price_cents) > 0
       then (coalesce(original_price_cents, price_cents) - price_cents)
            / coalesce(original_price_cents, price_cents)
       else 0.0 end as discount_rate,
  {sales_trunc('sv')} as sales_volume_num,
  case when {_none('di')} then 0.0 else {fee_lenient('trim(di)')} end as delivery_fee,
  case when {_none('di')} then null else {delivery_part('di', DATE_PATTERN)} end as delivery_date_text,
  case when {_none('di')} then null else {delivery_part('di', SHIP_PATTERN)} end as delivery_ship_to,
  case when {_none('di')} then null else {delivery_part('di', STOCK_PATTERN)} end as delivery_stock_note
from (
  select *, coalesce({ph('sales_volume')}, '0 bought in past month') as sv,
            coalesce({ph('delivery_info')}, 'No delivery information') as di
  from products
) p
where price_cents is not null and rating_x10 is not null
)"""

LISTING = f"""
listing as (
select * replace (coalesce(is_amazon_choice, false) as is_amazon_choice),
       false as is_best_seller
from cleaned
)"""


def _dim_values() -> str:
    rows = ", ".join(f"({_q(k)}, {_q(v)})" for k, v in sorted(category_mapping().items()))
    return f"category_dim as (select * from (values {rows}) as t(dim_key, dim_value))"


CATEGORY_DIM = _dim_values()


def disp_raw(c: str) -> str:
    return f"coalesce((select dim_value from category_dim where dim_key = {c}), {c})"


def disp_other(c: str) -> str:
    return f"coalesce((select dim_value from category_dim where dim_key = {c}), 'other')"


MARKET = f"""
market as (
select asin, row_k1, row_k2, row_k3,
  {disp_raw("coalesce(crawl_category, 'unknown')")} as category,
  coalesce(price_cents, 0) as price_cents, coalesce(rating_x10, 0) as rating_x10,
  coalesce(reviews, 0) as reviews, coalesce(sales_volume_num, 0) as sales,
  coalesce(is_amazon_choice, false) as is_amazon_choice,
  coalesce(is_climate_friendly, false) as is_climate_friendly,
  coalesce(has_variations, false) as has_variations
from listing
)"""

PRICE = f"""
price_base as (
select asin, row_k1, row_k2, row_k3, coalesce(price_cents, 0) as price_cents,
  coalesce(sales_volume_num, 0) as sales, {disp_raw('crawl_category')} as category
from listing where coalesce(price_cents, 0) > 0
),
price_th as (
select coalesce(cast(round_even(quantile_cont(price_cents, 0.33), 0) as bigint), 2000) as p33,
       coalesce(cast(round_even(quantile_cont(price_cents, 0.67), 0) as bigint), 7000) as p67
from price_base where price_cents > 0
),
price_rows as (
select b.*, case when price_cents <= (select p33 from price_th) then 1
                 when price_cents <= (select p67 from price_th) then 2 else 3 end as segment
from price_base b
)"""

DEAL = f"""
deal as (
select asin, row_k1, row_k2, row_k3,
  {disp_raw("coalesce(crawl_category, 'unknown')")} as category,
  coalesce(price_cents, 0) as price_cents,
  coalesce(original_price_cents, coalesce(price_cents, 0)) as original_price_cents,
  least(greatest(case when coalesce(original_price_cents, coalesce(price_cents, 0)) > 0
        then (coalesce(original_price_cents, coalesce(price_cents, 0)) - coalesce(price_cents, 0)) * 100.0
             / coalesce(original_price_cents, coalesce(price_cents, 0))
        else 0.0 end, 0.0), 100.0) as discount_pct,
  coalesce(sales_volume_num, 0) as sales,
  coalesce(is_prime, false) as is_prime
from listing
)"""

TRUST = f"""
trust as (
select asin, row_k1, row_k2, row_k3,
  {disp_other("coalesce(crawl_category, 'unknown')")} as category,
  coalesce(price_cents, 0) as price_cents,
  coalesce(original_price_cents, 0) as original_price_cents,
  coalesce(rating_x10, 0) as rating_x10, coalesce(reviews, 0) as reviews,
  coalesce(sales_volume_num, 0) as sales
from listing
)"""

BADGE = f"""
badge as (
select asin, row_k1, row_k2, row_k3,
  {disp_other("coalesce(crawl_category, 'unknown')")} as category,
  coalesce(is_amazon_choice, false) as is_amazon_choice,
  coalesce(is_best_seller, true) as is_best_seller,
  coalesce(is_prime, false) as is_prime,
  coalesce(price_cents, 0) as price_cents, coalesce(sales_volume_num, 0) as sales,
  coalesce(rating_x10, 0) as rating_x10, coalesce(reviews, 0) as reviews,
  case when coalesce(price_cents, 0) <= 1799 then 1
       when coalesce(price_cents, 0) <= 4699 then 2 else 3 end as price_tier
from listing
)"""

QUALITY_FIELDS = ["title", "price_cents", "original_price_cents", "rating", "reviews",
                  "has_variations", "is_climate_friendly", "number_of_offers", "variants",
                  "key_features", "full_description"]
QUANTITATIVE_FIELDS = ["rating", "reviews", "number_of_offers"]


def missing_sql(c: str) -> str:
    vocab = ["", "nan", "none", "[]", "{}", "false"]
    if c not in QUANTITATIVE_FIELDS:
        vocab += ["0", "0.0"]
    return f"({c} is null or lower(trim(cast({c} as varchar))) in {_in(vocab)})"


QUALITY = f"""
quality_base as (
select asin, row_k1, row_k2, row_k3, {disp_raw('crawl_category')} as category,
  coalesce(sales_volume_num, 0) as sales, coalesce(price_cents, 0) as price_cents,
  {", ".join(f"not {missing_sql(c)} as has_{c}" for c in QUALITY_FIELDS)},
  {" + ".join(f"cast({missing_sql(c)} as int)" for c in QUALITY_FIELDS)} as missing_count
from listing
),
quality_th as (
select coalesce(cast(round_even(quantile_cont(price_cents, 0.33), 0) as bigint), 1000) as p33,
       coalesce(cast(round_even(quantile_cont(price_cents, 0.67), 0) as bigint), 3000) as p67
from quality_base where price_cents > 0
),
quality as (
select b.*, case when price_cents <= (select p33 from quality_th) then 1
                 when price_cents <= (select p67 from quality_th) then 2 else 3 end as segment
from quality_base b
)"""

BASE_CTES = [RAW_LISTINGS, PRODUCTS, CLEAN, LISTING, CATEGORY_DIM, MARKET, PRICE, DEAL, TRUST,
             BADGE, QUALITY]


def with_base(body: str, extra: str = "") -> str:
    ctes = ",\n".join(c.strip() for c in BASE_CTES)
    if extra:
        ctes += ",\n" + extra.strip()
    if body.lstrip().lower().startswith("with "):
        body = f"select * from (\n{body}\n) q"
    return f"with {ctes}\n{body}"
