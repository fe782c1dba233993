"""Binning expressions (FE-11..FE-19, FE-24/25).

``bucketize`` counts the edges that are <= x (left-closed bins) or < x
(right-closed), a pure expression: no join, no Python, no shuffle.
Bins are 1-based; 0 means below the first edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucketize(c, edges: Sequence[float], closed: str = "left", open_end: bool = False) -> Column:
    """1-based index of the bin holding x, as one CASE chain from the top edge.

    ``closed='left'``: bins [e_i, e_{i+1}); ``'right'``: (e_i, e_{i+1}].
    ``open_end``: one more bin above the last edge (to +inf). Values outside
    all bins, and NULL, give NULL. x is referenced once per edge only, so a
    complex input expression stays small in generated code.
    """
    x = _c(c)

    def above(e):     # x lies past the lower boundary e of a bin
        return x >= F.lit(e) if closed == "left" else x > F.lit(e)

    n = len(edges)
    top = n if open_end else n - 1
    out = None if open_end else F.when(above(edges[-1]), F.lit(None))
    for i in range(top, 0, -1):
        cond = above(edges[i - 1])
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out.cast("int")


# The reference's bin edges and labels.
PRICE_BIN_EDGES = [0, 5, 10, 15, 20, 30, 50, 70, 100, 200]          # last bin open: >$200
PRICE_BIN_LABELS = ["<$5", "$5-10", "$10-15", "$15-20", "$20-30", "$30-50",
                    "$50-70", "$70-100", "$100-200", ">$200"]
DISCOUNT_BIN_EDGES = [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 101]   # percent, left-closed
DISCOUNT_BIN_LABELS = ["0-10%", "10-20%", "20-30%", "30-40%", "40-50%", "50-60%",
                       "60-70%", "70-80%", "80-90%", ">90%"]
DISCOUNT5_BIN_EDGES = [0, 20, 40, 60, 80, 101]
DISCOUNT5_BIN_LABELS = ["0-20%", "20-40%", "40-60%", "60-80%", "80-100%"]
RATING_GROUP_LABELS = ["<3.5", "3.5-3.9", "4.0-4.4", "4.5-4.7", "4.8-5.0"]
RATING_BIN_LABELS = ["0-1", "1-2", "2-3", "3-4", "4-5"]
REVIEW_QUARTILE_LABELS = ["Q1", "Q2", "Q3", "Q4"]
DISCOUNT_CLASS_LABELS = ["none", "<=20%", "20-50%", ">50%"]
PRICE_TIER_LABELS = ["budget", "mid", "premium"]
PRICE_TIER_EDGES = (17.99, 46.99)
SEGMENT_LABELS = ["LOW", "MID", "HIGH"]


def price_bin(price, scale: int = 1) -> Column:
    """FE-13: [0,5,10,15,20,30,50,70,100,200,inf) left-closed -> 1..10; negatives -> NULL.
    ``scale=100`` bins a price held in cents."""
    return bucketize(price, [e * scale for e in PRICE_BIN_EDGES], "left", open_end=True)


def discount_bin10(rate_pct) -> Column:
    """FE-14: ten bins of width 10 on the percent rate, last [90,101)."""
    return bucketize(rate_pct, DISCOUNT_BIN_EDGES, "left")


def discount_bin5(rate_pct) -> Column:
    """FE-15: five bins of width 20, last [80,101)."""
    return bucketize(rate_pct, DISCOUNT5_BIN_EDGES, "left")


def rating_bin(rating, keep_zero_quirk: bool = True) -> Column:
    """FE-16: right-closed (0,1],(1,2],..,(4,5] -> 1..5.

    The reference's chain sends r <= 0 to the second bin; kept when
    ``keep_zero_quirk`` (default), else such ratings get NULL.
    """
    r = _c(rating)
    first = (r > 0) & (r <= 1)
    chain = (F.when(first, 1).when(r <= 2, 2).when(r <= 3, 3)
             .when(r <= 4, 4).when(r <= 5, 5))
    if not keep_zero_quirk:
        chain = F.when(r > 0, chain)
    return chain


def rating_group(rating) -> Column:
    """FE-17: <3.5, [3.5,4), [4,4.5), [4.5,4.8), >=4.8 -> 1..5."""
    r = _c(rating)
    return (F.when(r < 3.5, 1).when(r < 4.0, 2).when(r < 4.5, 3)
            .when(r < 4.8, 4).when(r >= 4.8, 5))


def quartile_bucket(x, q25: Column, q50: Column, q75: Column) -> Column:
    """FE-18: >= from the top: >=q75 -> 4, >=q50 -> 3, >=q25 -> 2, else 1."""
    v = _c(x)
    return F.when(v >= q75, 4).when(v >= q50, 3).when(v >= q25, 2).otherwise(1)


def discount_class(rate_pct) -> Column:
    """FE-19: none (<=0) / (0,20] / (20,50] / >50 -> 1..4."""
    d = _c(rate_pct)
    return F.when(d <= 0, 1).when(d <= 20, 2).when(d <= 50, 3).when(d > 50, 4)


def price_tier(price, cents: bool = False) -> Column:
    """FE-12: <=17.99 budget(1), <=46.99 mid(2), else premium(3).

    ``cents=True`` compares integer cents (exact, no float edge effects)."""
    p = _c(price)
    lo, hi = PRICE_TIER_EDGES
    if cents:
        lo, hi = round(lo * 100), round(hi * 100)
    return F.when(p <= lo, 1).when(p <= hi, 2).otherwise(3)


def segment(price, p33: Column, p67: Column) -> Column:
    """FE-11: <= p33 LOW(1), <= p67 MID(2), else HIGH(3)."""
    p = _c(price)
    return F.when(p <= p33, 1).when(p <= p67, 2).otherwise(3)


def label_of(idx, labels: Sequence[str]) -> Column:
    """Text label for a 1-based bin index, by a literal array lookup."""
    arr = F.array(*[F.lit(s) for s in labels])
    i = _c(idx)
    return F.when((i >= 1) & (i <= len(labels)), F.element_at(arr, i.cast("int")))


def potential_badge(units) -> Column:
    """FE-24: >200 high, >50 stable, else optimise."""
    u = _c(units)
    return F.when(u > 200, "high").when(u > 50, "stable").otherwise("optimise")


def sales_level(units) -> Column:
    """FE-25 colour level: >2000 high(3), >500 mid(2), else low(1)."""
    u = _c(units)
    return F.when(u > 2000, 3).when(u > 500, 2).otherwise(1)
