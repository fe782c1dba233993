"""Dashboard filters (FLT-01..FLT-07) as plain predicates.

They are ordinary ``where`` clauses over the prepared frames, so Catalyst
pushes whatever reaches a scan column down to the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.sources.fixtures import category_mapping

# The special-flag filter choices of the market tab.
SPECIAL_FLAGS = {"choice": "is_amazon_choice", "climate": "is_climate_friendly",
                 "variations": "has_variations"}


def shown_as(display: str, raw: str = "crawl_category", unknown: str = "unknown") -> Column:
    """FLT-01 on the stored key: rows whose category is shown as ``display`` (FE-09, raw fallback).

    The dictionary is inverted, so the predicate is a list of keys and reaches the scan.
    """
    names = category_mapping()
    keys = [k for k, v in names.items() if v == display] + ([display] if display not in names else [])
    kept = F.col(raw).isin(*keys)
    return kept | F.col(raw).isNull() if names.get(unknown, unknown) == display else kept


def apply_filters(df: DataFrame, category: str | None = None, special: str | None = None,
                  prime_only: bool = False, segment: int | None = None,
                  discount_range: tuple[float, float] | None = None,
                  category_col: str = "category") -> DataFrame:
    """FLT-01..05 in one call; ``None``/``False`` means "ALL" for that control."""
    conds: list[Column] = []
    if category is not None:                       # FLT-01
        conds.append(F.col(category_col) == category)
    if special is not None:                        # FLT-02
        conds.append(F.col(SPECIAL_FLAGS[special]))
    if prime_only:                                 # FLT-03
        conds.append(F.col("is_prime"))
    if segment is not None:                        # FLT-04
        conds.append(F.col("segment") == segment)
    if discount_range is not None:                 # FLT-05: [lo, hi)
        lo, hi = discount_range
        conds.append((F.col("discount_pct") >= lo) & (F.col("discount_pct") < hi))
    for c in conds:
        df = df.where(c)
    return df


def positive(c: str) -> Column:
    """FLT-06: strictly positive measure."""
    return F.col(c) > 0


def scatter_points(df: DataFrame, max_price_cents: int = 20000) -> DataFrame:
    """FLT-07: rows with sales and price <= $200."""
    return df.where((F.col("sales") > 0) & (F.col("price_cents") <= max_price_cents))
