"""Listing-completeness questions (AG-29..AG-37)."""

from __future__ import annotations

from marketlens.operators.aggregates import quality as Q
from marketlens.plans import oracle as O
from marketlens.plans.catalog import register
from marketlens.plans.frames import QUALITY_FIELDS, listing_table, quality_frame


def _q(spark, d):
    return quality_frame(listing_table(spark, d))


SEG_LABEL = "case segment when 1 then 'LOW' when 2 then 'MID' else 'HIGH' end"
FIELDS = ", ".join(QUALITY_FIELDS)

CELLS_SQL = f"""
cells as (
  select case when grouping(category) = 1 then 'ALL' else category end as cell_category,
         case when grouping(segment) = 1 then 'ALL' else {SEG_LABEL} end as cell_segment,
         count(*) as listings,
         {", ".join(f"count(*) filter (where has_{c}) as {c}" for c in QUALITY_FIELDS)},
         sum(missing_count) as missing_count
  from quality group by cube(category, segment)
),
all_long as (
  select cell_category, cell_segment, field, listings, cast(provided as bigint) as provided,
         provided * 100.0 / listings as provided_pct
  from cells unpivot (provided for field in ({FIELDS}))
),
exploded as (
  select q.*, c.cell_category, c.cell_segment from quality q,
  lateral (select * from (values (q.category, {SEG_LABEL.replace('segment', 'q.segment')}),
                                 (q.category, 'ALL'),
                                 ('ALL', {SEG_LABEL.replace('segment', 'q.segment')}),
                                 ('ALL', 'ALL')) v(cell_category, cell_segment)) c
  where c.cell_category is not null
),
ranked as (
  select *, row_number() over (partition by cell_category, cell_segment
                               order by sales desc, row_k1, row_k2, row_k3, asin) as rn,
         count(*) over (partition by cell_category, cell_segment) as n
  from exploded
),
top_cells as (
  select cell_category, cell_segment, count(*) as listings,
         {", ".join(f"count(*) filter (where has_{c}) as {c}" for c in QUALITY_FIELDS)}
  from ranked where rn <= greatest(1, floor(n * 0.1)) group by 1, 2
),
top_long as (
  select cell_category, cell_segment, field, listings, cast(provided as bigint) as provided,
         provided * 100.0 / listings as provided_pct
  from top_cells unpivot (provided for field in ({FIELDS}))
),
joined as (
  select a.cell_category, a.cell_segment, a.field, a.listings, a.provided as all_provided,
         t.provided as top_provided, a.provided_pct as all_pct, t.provided_pct as top_pct
  from all_long a join top_long t using (cell_category, cell_segment, field)
)"""


@register("ag_29", O.with_base("select * from all_long", CELLS_SQL))
def ag_29(spark, d):
    return Q.provided_by_cell(_q(spark, d))


@register("ag_30", O.with_base("select * from top_long", CELLS_SQL))
def ag_30(spark, d):
    return Q.top_provided_by_cell(_q(spark, d))


@register("ag_31", O.with_base("""
select cell_category, cell_segment, field, top_pct, all_pct, lift, lift_rank, is_headline from (
  select *, row_number() over (partition by cell_category, cell_segment
                               order by lift desc, field) as lift_rank,
         (row_number() over (partition by cell_category, cell_segment
                             order by (top_pct > 5) desc, lift desc, field) = 1)
           and top_pct > 5 and lift > 0.1 as is_headline
  from (select *, top_pct - all_pct as lift from joined) j
) r where lift_rank <= 7 or is_headline""", CELLS_SQL))
def ag_31(spark, d):
    return Q.field_lift(_q(spark, d))


@register("ag_32", O.with_base("""
select cell_category, cell_segment, field, top_provided, all_provided, concentration_pct,
       concentration_pct / 10 as uplift, rank from (
  select *, row_number() over (partition by cell_category, cell_segment
                               order by concentration_pct desc, field) as rank
  from (select *, top_provided * 100.0 / all_provided as concentration_pct from joined
        where all_provided >= greatest(10.0, listings * 0.01)) j
) r where rank <= 7""", CELLS_SQL))
def ag_32(spark, d):
    return Q.field_concentration(_q(spark, d))


@register("ag_33", O.with_base("""
select cell_category, cell_segment, listings, missing_count / listings as missing_mean from cells""",
                               CELLS_SQL))
def ag_33(spark, d):
    return Q.mean_missing_by_cell(_q(spark, d))


# The adaptive bins as a walk over each cell's ordered histogram.
HIST_SQL = CELLS_SQL + """,
hist as (
  select cell_category, cell_segment, cast(case when missing_count >= 34 then 999 else missing_count end as int) as mkey,
         count(*) as cnt, min(missing_count) as vmin, max(missing_count) as vmax
  from exploded group by 1, 2, 3
),
steps as (
  select *, row_number() over (partition by cell_category, cell_segment order by mkey) as rn,
         sum(cnt) over (partition by cell_category, cell_segment) / 7.0 as share
  from hist
)"""
OPENS = """case when w.nth < 7 and (w.held + s.cnt > s.share * 1.5 or w.held > s.share * 0.7
                          or s.mkey in (15, 18, 28, 999)) then 1 else 0 end"""
BINS_SQL = f"""with recursive walk as (
  select cell_category, cell_segment, mkey, rn, 1 as nth, cnt as held, vmin, vmax from steps where rn = 1
  union all
  select s.cell_category, s.cell_segment, s.mkey, s.rn, w.nth + {OPENS},
         case when {OPENS} = 1 then s.cnt else w.held + s.cnt end, s.vmin, s.vmax
  from walk w join steps s on s.cell_category = w.cell_category and s.cell_segment = w.cell_segment and s.rn = w.rn + 1
),
spans as (
  select *, min(vmin) over (partition by cell_category, cell_segment, nth) as lo,
         max(vmax) over (partition by cell_category, cell_segment, nth) as hi
  from walk
),
lone as (
  select cell_category, cell_segment, max(case when lo = 29 and hi = 29 then nth end) as one,
         max(case when lo = 30 and hi in (30, 31) then nth end) as two
  from spans group by 1, 2
),
bins as (
  select s.cell_category, s.cell_segment, s.mkey,
         cast(nth - case when two = one + 1 and nth > one then 1 else 0 end as int) as bin,
         case when two = one + 1 and nth in (one, two) then '29-31' when lo >= 34 then '34+'
              when lo = hi then cast(lo as varchar) else lo || '-' || hi end as bin_label
  from spans s join lone l on s.cell_category = l.cell_category and s.cell_segment = l.cell_segment
),
binned as (
  select e.*, b.bin, b.bin_label from exploded e join bins b
  on e.cell_category = b.cell_category and e.cell_segment = b.cell_segment
     and b.mkey = case when e.missing_count >= 34 then 999 else e.missing_count end
),
per_bin as (
  select cell_category, cell_segment, bin, bin_label, count(*) as listings, avg(sales) as sales_mean, median(sales) as sales_median
  from binned group by 1, 2, 3, 4
)
"""


@register("ag_34", O.with_base(BINS_SQL + "select * from bins", HIST_SQL))
def ag_34(spark, d):
    return Q.adaptive_bins(_q(spark, d))


@register("ag_35", O.with_base(BINS_SQL + "select * from per_bin", HIST_SQL))
def ag_35(spark, d):
    return Q.sales_by_missing_bin(_q(spark, d))


@register("ag_36", O.with_base(BINS_SQL + """
select cell_category, cell_segment, min_by(s, bin) as best_sales, max_by(s, bin) as worst_sales, count(*) as bins,
       min_by(s, bin) - max_by(s, bin) as difference
from (select *, cast(floor(sales_mean + 0.5) as bigint) as s from per_bin) p group by 1, 2""", HIST_SQL))
def ag_36(spark, d):
    return Q.best_vs_worst_bin(_q(spark, d))


@register("ag_37", O.with_base(BINS_SQL + """
select cell_category, cell_segment, bin, bin_label, listings, top_listings, top_listings * 100.0 / listings as top_pct,
       top_listings * 100.0 / listings / 10 as uplift
from (
  select b.cell_category, b.cell_segment, bin, bin_label, count(*) as listings,
         count(*) filter (where sales >= threshold and sales > 0) as top_listings
  from binned b join (select cell_category as c, cell_segment as s, min(sales) as threshold from ranked
                      where rn <= greatest(1, floor(n * 0.1)) group by 1, 2) t
  on b.cell_category = t.c and b.cell_segment = t.s group by 1, 2, 3, 4) x""", HIST_SQL))
def ag_37(spark, d):
    return Q.top_decile_share_by_bin(_q(spark, d))
