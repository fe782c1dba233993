"""Market overview, price, deal, rating and badge questions (AG-01..AG-28)."""

from __future__ import annotations

from marketlens.operators.aggregates import badge as B
from marketlens.operators.aggregates import deals as D
from marketlens.operators.aggregates import market as M
from marketlens.operators.aggregates import price as P
from marketlens.operators.aggregates import trust as T
from marketlens.plans import oracle as O
from marketlens.plans.catalog import register
from marketlens.plans.frames import (badge_frame, deal_frame, listing_table, market_frame,
                                     price_frame, trust_frame)


def _lst(spark, d):
    return listing_table(spark, d)


def _labels(name: str, labels: list[str]) -> str:
    rows = ", ".join(f"({i + 1}, {O._q(s)})" for i, s in enumerate(labels))
    return f"(select * from (values {rows}) t({name}, {name}_label))"


# ---------------------------------------------------------------- market tab

@register("ag_01", O.with_base("""
select count(distinct asin) as products, count(*) as records,
       count(distinct crawl_category) as categories,
       coalesce(avg(cast(is_best_seller as int)) * 100, 0.0) as best_seller_pct
from listing"""))
def ag_01(spark, d):
    return M.table_kpis(_lst(spark, d))


@register("ag_02", O.with_base("""
select count(*) as listings, coalesce(avg(price_cents), 0.0) as price_mean_cents,
  coalesce(quantile_cont(price_cents, 0.5), 0.0) as price_median_cents,
  coalesce(avg(sales), 0.0) as sales_mean, coalesce(quantile_cont(sales, 0.5), 0.0) as sales_median,
  coalesce(avg(rating_x10) / 10, 0.0) as rating_mean,
  count(*) filter (where is_amazon_choice) as choice_listings,
  coalesce(avg(cast(is_amazon_choice as int)) * 100, 0.0) as choice_pct
from market"""))
def ag_02(spark, d):
    return M.market_kpis(market_frame(_lst(spark, d)))


@register("ag_03", O.with_base("""
select category, count(*) as listings from market group by category
order by listings desc, category limit 10"""))
def ag_03(spark, d):
    return M.top_categories(market_frame(_lst(spark, d)), 10)


@register("ag_04", O.with_base("""
select * from (select count(*) filter (where is_amazon_choice) as is_amazon_choice,
  count(*) filter (where is_climate_friendly) as is_climate_friendly,
  count(*) filter (where has_variations) as has_variations from market)
unpivot (listings for flag in (is_amazon_choice, is_climate_friendly, has_variations))"""))
def ag_04(spark, d):
    return M.flag_counts(market_frame(_lst(spark, d)))


@register("ag_05", O.with_base("""
select category, count(*) as listings, avg(price_cents) as price_mean_cents,
  quantile_cont(price_cents, 0.5) as price_median_cents, avg(sales) as sales_mean,
  quantile_cont(sales, 0.5) as sales_median
from market where category in (
  select category from market group by category order by count(*) desc, category limit 8)
group by category"""))
def ag_05(spark, d):
    return M.top_category_measures(market_frame(_lst(spark, d)), 8)


RATING_BIN_SQL = """case when rating_x10 > 0 and rating_x10 <= 10 then 1
  when rating_x10 <= 20 then 2 when rating_x10 <= 30 then 3
  when rating_x10 <= 40 then 4 when rating_x10 <= 50 then 5 end"""


@register("ag_06", O.with_base(f"""
select l.rating_bin, l.rating_bin_label, coalesce(g.listings, 0) as listings
from {_labels('rating_bin', ['0-1', '1-2', '2-3', '3-4', '4-5'])} l left join (
  select {RATING_BIN_SQL} as rating_bin, count(*) as listings from market group by 1) g
on g.rating_bin = l.rating_bin"""))
def ag_06(spark, d):
    return M.rating_distribution(market_frame(_lst(spark, d)))


# ----------------------------------------------------------------- price tab

@register("ag_07", O.with_base("""
with seg as (select segment, count(*) as n from price_rows group by segment),
dom as (select segment, n from seg order by n desc, segment limit 1)
select avg(price_cents) as mean_price_cents, quantile_cont(price_cents, 0.5) as median_price_cents,
  count(*) as listings, count(*) filter (where sales > 0) as listings_with_sales,
  (count(*) filter (where sales > 0)) / count(*) as with_sales_share,
  (select segment from dom) as dominant_segment,
  (select case segment when 1 then 'LOW' when 2 then 'MID' else 'HIGH' end from dom)
     as dominant_segment_label,
  (select n from dom) / count(*) as dominant_share
from price_rows"""))
def ag_07(spark, d):
    return P.price_kpis(price_frame(_lst(spark, d)))


@register("ag_08", O.with_base("""
with pos as (select * from price_rows where sales > 0),
r as (select row_number() over (order by price_cents, row_k1, row_k2, row_k3, asin) as rx,
             row_number() over (order by sales, row_k1, row_k2, row_k3, asin) as ry from pos),
a as (select count(*) as n, sum(cast((rx - ry) * (rx - ry) as hugeint)) as sd2 from r)
select n, case when n > 30 then 1.0 - cast(sd2 * 6 as double) / cast(cast(n as hugeint) * (cast(n as hugeint) * n - 1) as double)
               else 0.0 end as spearman from a"""))
def ag_08(spark, d):
    return P.spearman_price_sales(price_frame(_lst(spark, d)))


@register("ag_09", O.with_base(f"""
select l.segment, l.segment_label, coalesce(g.listings, 0) as listings,
  coalesce(g.listings, 0) / (select count(*) from price_rows) as share
from {_labels('segment', ['LOW', 'MID', 'HIGH'])} l
left join (select segment, count(*) as listings from price_rows group by segment) g using (segment)"""))
def ag_09(spark, d):
    return P.segment_share(price_frame(_lst(spark, d)))


# ------------------------------------------------------------------ deal tab

@register("ag_12", O.with_base("""
select count(*) as listings, coalesce(cast(sum(cast(round(discount_pct * 1000000000) as bigint)) as double) / count(*) / 1000000000, 0.0) as discount_mean_pct,
  coalesce(avg(cast(discount_pct > 0 as int)) * 100, 0.0) as discounted_pct,
  coalesce(avg(price_cents), 0.0) as price_mean_cents,
  coalesce(quantile_cont(price_cents, 0.5), 0.0) as price_median_cents,
  cast(coalesce(sum(sales), 0) as bigint) as sales_total
from deal"""))
def ag_12(spark, d):
    return D.deal_kpis(deal_frame(_lst(spark, d)))


def _dbin(edges):
    parts = [f"when discount_pct >= {e} then {i + 1}" for i, e in reversed(list(enumerate(edges[:-1])))]
    return (f"case when discount_pct < {edges[0]} or discount_pct >= {edges[-1]} then null "
            f"{' '.join(parts)} end")


D10 = _dbin([0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 101])
D5 = _dbin([0, 20, 40, 60, 80, 101])
D10_LABELS = ["0-10%", "10-20%", "20-30%", "30-40%", "40-50%", "50-60%", "60-70%", "70-80%",
              "80-90%", ">90%"]


@register("ag_13", O.with_base(f"""
select l.discount_bin, l.discount_bin_label, coalesce(g.listings, 0) as listings
from {_labels('discount_bin', D10_LABELS)} l left join (
  select {D10} as discount_bin, count(*) as listings from deal group by 1) g using (discount_bin)"""))
def ag_13(spark, d):
    return D.discount_histogram(deal_frame(_lst(spark, d)))


@register("ag_14", O.with_base(f"""
select l.discount_bin, l.discount_bin_label, coalesce(g.selling, 0) as selling,
  coalesce(g.sales_mean, 0.0) as sales_mean, coalesce(g.sales_median, 0.0) as sales_median
from {_labels('discount_bin', D10_LABELS)} l left join (
  select {D10} as discount_bin, count(*) as selling, avg(sales) as sales_mean,
         quantile_cont(sales, 0.5) as sales_median
  from deal where sales > 0 group by 1) g using (discount_bin)"""))
def ag_14(spark, d):
    return D.sales_by_discount(deal_frame(_lst(spark, d)))


@register("ag_15", O.with_base(f"""
select l.discount_class, l.discount_class_label, coalesce(g.listings, 0) as listings
from {_labels('discount_class', ['none', '<=20%', '20-50%', '>50%'])} l left join (
  select case when discount_pct <= 0 then 1 when discount_pct <= 20 then 2
              when discount_pct <= 50 then 3 else 4 end as discount_class, count(*) as listings
  from deal group by 1) g using (discount_class)"""))
def ag_15(spark, d):
    return D.discount_classes(deal_frame(_lst(spark, d)))


CAT_DEAL = """(select category, cast(sum(cast(round(discount_pct * 1000000000) as bigint)) as double) / count(*) / 1000000000 as discount_mean_pct,
  cast(sum(sales) as bigint) as sales_total from deal group by category)"""


@register("ag_16", O.with_base(f"select * from {CAT_DEAL} c order by discount_mean_pct desc, category limit 5"))
def ag_16(spark, d):
    return D.top_discount_categories(deal_frame(_lst(spark, d)))


@register("ag_17", O.with_base(f"select * from {CAT_DEAL} c order by sales_total desc, category limit 5"))
def ag_17(spark, d):
    return D.top_sales_categories(deal_frame(_lst(spark, d)))


@register("ag_18", O.with_base("""
with pos as (select * from deal where price_cents > 0),
st as (select category, greatest((max(price_cents) + 499) // 500, 1) as step from pos group by category),
grid as (select category, step, unnest(range(1, 6)) as bin from st),
cnt as (select p.category, cast(floor(p.price_cents / (s.step * 100)) as int) + 1 as bin, count(*) as listings
        from pos p join st s using (category) group by 1, 2)
select g.category, g.bin, (g.bin - 1) * g.step as bin_low, g.bin * g.step as bin_high,
       coalesce(c.listings, 0) as listings
from grid g left join cnt c on c.category = g.category and c.bin = g.bin"""))
def ag_18(spark, d):
    return D.category_price_histogram(deal_frame(_lst(spark, d)))


@register("ag_19", O.with_base(f"""
with g as (select category, {D5} as discount_bin, count(*) as selling, avg(sales) as sales_mean
           from deal where sales > 0 group by 1, 2 having discount_bin is not null),
grid as (select category, unnest(range(1, 6)) as discount_bin from (select distinct category from deal))
select grid.category, grid.discount_bin, l.discount_bin_label,
       coalesce(g.selling, 0) as selling, coalesce(g.sales_mean, 0.0) as sales_mean
from grid join {_labels('discount_bin', ['0-20%', '20-40%', '40-60%', '60-80%', '80-100%'])} l
  using (discount_bin)
left join g on g.category = grid.category and g.discount_bin = grid.discount_bin"""))
def ag_19(spark, d):
    return D.category_sales_by_discount(deal_frame(_lst(spark, d)))


# ---------------------------------------------------------------- rating tab

@register("ag_20", O.with_base("""
select coalesce(avg(rating_x10) filter (where rating_x10 > 0) / 10, 0.0) as rating_mean,
       cast(coalesce(sum(reviews), 0) as bigint) as reviews_total from trust"""))
def ag_20(spark, d):
    return T.rating_kpis(trust_frame(_lst(spark, d)))


def _up(a, b):
    return f"case when {b} > 0 then ({a} - {b}) / {b} * 100 end"


@register("ag_21", O.with_base(f"""
select *, {_up('high_sales_mean', 'low_sales_mean')} as uplift_mean_pct,
          {_up('high_sales_median', 'low_sales_median')} as uplift_median_pct from (
select coalesce(avg(sales) filter (where rating_x10 >= 45 and sales > 0), 0.0) as high_sales_mean,
       coalesce(avg(sales) filter (where rating_x10 < 45 and sales > 0), 0.0) as low_sales_mean,
       coalesce(quantile_cont(sales, 0.5) filter (where rating_x10 >= 45 and sales > 0), 0.0) as high_sales_median,
       coalesce(quantile_cont(sales, 0.5) filter (where rating_x10 < 45 and sales > 0), 0.0) as low_sales_median
from trust) x"""))
def ag_21(spark, d):
    return T.high_low_sales(trust_frame(_lst(spark, d)))


@register("ag_22", O.with_base("""
select *, high_price_mean_cents - low_price_mean_cents as difference_cents from (
select coalesce(avg(price_cents) filter (where rating_x10 >= 45 and price_cents > 0), 0.0) as high_price_mean_cents,
       coalesce(avg(price_cents) filter (where rating_x10 < 45 and price_cents > 0), 0.0) as low_price_mean_cents
from trust) x"""))
def ag_22(spark, d):
    return T.high_low_price(trust_frame(_lst(spark, d)))


@register("ag_23", O.with_base("""
with q as (select coalesce(quantile_cont(reviews, 0.75), 0.0) as q75 from trust where reviews > 0)
select coalesce(avg(sales) filter (where reviews >= q75 and sales > 0), 0.0) as top_sales_mean,
       coalesce(avg(sales) filter (where reviews < q75 and sales > 0), 0.0) as rest_sales_mean,
       coalesce(quantile_cont(sales, 0.5) filter (where reviews >= q75 and sales > 0), 0.0) as top_sales_median,
       coalesce(quantile_cont(sales, 0.5) filter (where reviews < q75 and sales > 0), 0.0) as rest_sales_median,
       coalesce(avg(price_cents) filter (where reviews >= q75 and price_cents > 0), 0.0) as top_price_mean_cents,
       coalesce(avg(price_cents) filter (where reviews < q75 and price_cents > 0), 0.0) as rest_price_mean_cents,
       min(q75) as reviews_q75
from trust, q"""))
def ag_23(spark, d):
    return T.top_reviewed_vs_rest(trust_frame(_lst(spark, d)))


def _group_sql(key: str, expr: str, labels: list[str], extra_from: str = "") -> str:
    return f"""
select l.{key}, l.{key}_label, coalesce(g.sales_mean, 0.0) as sales_mean,
  coalesce(g.sales_median, 0.0) as sales_median, coalesce(g.price_mean_cents, 0.0) as price_mean_cents,
  coalesce(g.sales_count, 0) as sales_count, coalesce(g.price_count, 0) as price_count
from {_labels(key, labels)} l left join (
  select {expr} as {key}, avg(sales) filter (where sales > 0) as sales_mean,
    quantile_cont(sales, 0.5) filter (where sales > 0) as sales_median,
    avg(price_cents) filter (where price_cents > 0) as price_mean_cents,
    count(*) filter (where sales > 0) as sales_count, count(*) filter (where price_cents > 0) as price_count
  from trust {extra_from} group by 1) g using ({key})"""


@register("ag_24", O.with_base(_group_sql("rating_group", """case when rating_x10 < 35 then 1
  when rating_x10 < 40 then 2 when rating_x10 < 45 then 3 when rating_x10 < 48 then 4 else 5 end""",
                                          ["<3.5", "3.5-3.9", "4.0-4.4", "4.5-4.7", "4.8-5.0"])))
def ag_24(spark, d):
    return T.by_rating_group(trust_frame(_lst(spark, d)))


@register("ag_25", O.with_base(_group_sql(
    "review_quartile", """case when reviews >= q75 then 4 when reviews >= q50 then 3
  when reviews >= q25 then 2 else 1 end""", ["Q1", "Q2", "Q3", "Q4"],
    ", (select quantile_cont(reviews, 0.25) as q25, quantile_cont(reviews, 0.5) as q50, "
    "quantile_cont(reviews, 0.75) as q75 from trust) q")))
def ag_25(spark, d):
    return T.by_review_quartile(trust_frame(_lst(spark, d)))


@register("ag_26", O.with_base("""
select min(reviews) as reviews_min, max(reviews) as reviews_max,
       cast(floor(log10(min(reviews))) as bigint) as log_min,
       cast(ceil(log10(max(reviews))) as bigint) as log_max
from trust where rating_x10 >= 10 and reviews > 0"""))
def ag_26(spark, d):
    return T.scatter_domain(trust_frame(_lst(spark, d)))


# ----------------------------------------------------------------- badge tab

@register("ag_27", O.with_base("""
select *, case when other_sales_mean > 0
               then (badge_sales_mean - other_sales_mean) / other_sales_mean * 100 else 0.0 end
          as sales_uplift_pct from (
select count(*) filter (where is_amazon_choice) as badge_listings,
       count(*) filter (where not is_amazon_choice) as other_listings,
       coalesce(avg(sales) filter (where is_amazon_choice), 0.0) as badge_sales_mean,
       coalesce(avg(sales) filter (where not is_amazon_choice), 0.0) as other_sales_mean,
       coalesce(avg(rating_x10) filter (where is_amazon_choice) / 10, 0.0) as badge_rating_mean,
       coalesce(avg(reviews) filter (where is_amazon_choice), 0.0) as badge_reviews_mean
from badge) x"""))
def ag_27(spark, d):
    return B.badge_vs_rest(badge_frame(_lst(spark, d)))


@register("ag_28", O.with_base(f"""
select l.price_tier, l.price_tier_label, coalesce(g.listings, 0) as listings,
       coalesce(g.badge_pct, 0.0) as badge_pct
from {_labels('price_tier', ['budget', 'mid', 'premium'])} l left join (
  select price_tier, count(*) as listings, avg(cast(is_amazon_choice as int)) * 100 as badge_pct
  from badge group by price_tier) g using (price_tier)"""))
def ag_28(spark, d):
    return B.badge_rate_by_tier(badge_frame(_lst(spark, d)))
