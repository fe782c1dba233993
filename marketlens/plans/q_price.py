"""Price-strategy questions (AG-07..AG-11, FLT-04/07, FE-11/13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators.aggregates import price as P
from marketlens.plans import oracle as O
from marketlens.plans.catalog import register
from marketlens.plans.frames import listing_table, price_frame


def _price(spark, d):
    return price_frame(listing_table(spark, d))


PRICE_BIN_SQL = """
bins as (select range::int as price_bin from range(1, 11)),
labels as (select * from (values (1,'<$5'),(2,'$5-10'),(3,'$10-15'),(4,'$15-20'),(5,'$20-30'),
   (6,'$30-50'),(7,'$50-70'),(8,'$70-100'),(9,'$100-200'),(10,'>$200')) t(price_bin, price_bin_label)),
binned as (
  select case when price_cents >= 20000 then 10 when price_cents >= 10000 then 9
              when price_cents >= 7000 then 8 when price_cents >= 5000 then 7
              when price_cents >= 3000 then 6 when price_cents >= 2000 then 5
              when price_cents >= 1500 then 4 when price_cents >= 1000 then 3
              when price_cents >= 500 then 2 else 1 end as price_bin, sales
  from price_rows where price_cents >= 0
),
bin_sales as (
  select b.price_bin, l.price_bin_label, coalesce(count(x.sales), 0) as listings,
         coalesce(avg(x.sales), 0.0) as sales_mean,
         coalesce(quantile_cont(x.sales, 0.5), 0.0) as sales_median
  from bins b join labels l using (price_bin) left join binned x on x.price_bin = b.price_bin
  group by b.price_bin, l.price_bin_label
)"""


@register("ag_10", O.with_base("select * from bin_sales", PRICE_BIN_SQL))
def ag_10(spark, d):
    return P.price_bin_sales(_price(spark, d))


@register("ag_11", O.with_base("""
select price_bin, price_bin_label, listings, bin_sales,
       (listings / greatest(max(listings) over (), 1) < 0.3)
       and (bin_sales / greatest(max(bin_sales) over (), 1) > 0.15) as is_gap
from (select *, cast(floor(sales_median + 0.5) as bigint) as bin_sales from bin_sales) s
""", PRICE_BIN_SQL))
def ag_11(spark, d):
    return P.market_gaps(P.price_bin_sales(_price(spark, d)), how="median")
