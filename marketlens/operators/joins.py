"""Dimension lookups, enrichment merge and threshold attachment (J-01..J-08).

Broadcast is used only for frames whose size is bounded by construction
(a fixed dictionary, a one-row statistic, one row per partition); anything
that grows with the data joins by shuffle and is left to AQE.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources.fixtures import category_mapping

# A literal dimension above this many rows is not broadcast.
BROADCAST_MAX_ROWS = 100_000


def _map_literal(mapping: Mapping[str, str]) -> Column:
    kv = []
    for k, v in sorted(mapping.items()):
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def category_display(cat: Column, fallback: str = "raw",
                     mapping: Mapping[str, str] | None = None,
                     other_label: str = "other") -> Column:
    """FE-09 / FE-10: display name of a raw category key.

    ``fallback='raw'``: unmapped -> the raw key (FE-09);
    ``fallback='other'``: unmapped -> ``other_label`` (FE-10).
    A literal map lookup: stays inside codegen, no join needed.
    """
    m = _map_literal(mapping or category_mapping())
    hit = F.try_element_at(m, cat)
    return F.coalesce(hit, cat if fallback == "raw" else F.lit(other_label))


def dimension_frame(spark: SparkSession, mapping: Mapping[str, str],
                    key: str, value: str) -> DataFrame:
    """A small dimension frame from a fixed dictionary."""
    rows = sorted(mapping.items())
    return spark.createDataFrame(rows, f"{key} string, {value} string")


def lookup_join(df: DataFrame, dim: DataFrame, on: str, value: str,
                default: Column | None = None, dim_rows: int | None = None) -> DataFrame:
    """J-01: left equi join to a dimension + coalesce with a default.

    The dimension is broadcast only when its row count is known and bounded
    (``dim_rows`` from the literal it was built from); otherwise the join is
    left to the planner (sort-merge, AQE may still switch to broadcast after
    measuring the real size).
    """
    right = F.broadcast(dim) if dim_rows is not None and dim_rows <= BROADCAST_MAX_ROWS else dim
    out = df.join(right, on, "left")
    if default is not None:
        out = out.withColumn(value, F.coalesce(F.col(value), default))
    return out


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """J-08: attach the columns of a one-row statistics frame to every row.

    Each column becomes a scalar subquery: evaluated once, inlined as a
    literal; no cross join, nothing grows with the data.
    """
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})


def enrich(search: DataFrame, details: DataFrame, reviews: DataFrame, key: str = "asin") -> DataFrame:
    """J-02: every search item left-joined to details and to the review endpoint.

    ``details`` and ``reviews`` must be unique per key (pre-aggregated); both
    grow with the data, so the joins shuffle on the key (no broadcast), and
    AQE's skew handling splits a hot key on the search side.
    """
    d = details.select(key, *[F.col(c).alias(f"d_{c}") for c in details.columns if c != key],
                       F.lit(True).alias("_has_details"))
    r = reviews.select(key, *[F.col(c).alias(f"e_{c}") for c in reviews.columns if c != key])
    return search.join(d, key, "left").join(r, key, "left") \
        .withColumn("_has_details", F.coalesce(F.col("_has_details"), F.lit(False)))


def merge_details(enriched: DataFrame, fields: Sequence[str]) -> DataFrame:
    """J-03: details keys override search keys, even when the details value is NULL."""
    return enriched.withColumns({
        f: F.when(F.col("_has_details"), F.col(f"d_{f}")).otherwise(F.col(f))
        for f in fields if f"d_{f}" in enriched.columns})


# Fields backfilled from search also when the detail text is "".
TEXT_BACKFILL = ["title", "asin", "link", "image_url"]
# Fields that the search item never fills.
NOT_BACKFILLED = ["price_cents", "current_price_cents", "has_variations"]


def backfill_from_search(merged: DataFrame, search_cols: dict[str, str],
                         text_fields: Sequence[str] = TEXT_BACKFILL) -> DataFrame:
    """J-04: fill gaps of the merged record from the search item.

    ``search_cols`` maps field -> search column. Text identity fields are
    filled when NULL or ""; others only when NULL. Price and ``has_variations``
    are never filled from search: price and current price fill each other.
    """
    out = {}
    for f, s in search_cols.items():
        if f in NOT_BACKFILLED:
            continue
        if f in text_fields:
            out[f] = F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(s))
        else:
            out[f] = F.coalesce(F.col(f), F.col(s))
    df = merged.withColumns(out)
    if "price_cents" in df.columns and "current_price_cents" in df.columns:
        df = df.withColumns({
            "price_cents": F.coalesce(F.col("price_cents"), F.col("current_price_cents")),
            "current_price_cents": F.coalesce(F.col("current_price_cents"), F.col("price_cents"))})
    return df


def review_fallback(endpoint_reviews, detail_reviews, element_ddl: str, n: int = 3) -> Column:
    """J-05: endpoint reviews when any, else the details' reviews, else []; first n."""
    e = F.col(endpoint_reviews) if isinstance(endpoint_reviews, str) else endpoint_reviews
    d = F.col(detail_reviews) if isinstance(detail_reviews, str) else detail_reviews
    empty = F.array().cast(f"array<{element_ddl}>")
    chosen = F.when(F.coalesce(F.size(e), F.lit(0)) > 0, e).otherwise(F.coalesce(d, empty))
    return F.slice(chosen, 1, n)


def keep_rows_with_key(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """J-06: rows whose key appears in ``keys`` (left semi join)."""
    return df.join(keys, list(on), "left_semi")
