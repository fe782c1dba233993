"""Shared aggregate helpers: metric toggle, zero-on-empty, bin-list completion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.bins import label_of


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def metric(c, how: str = "mean") -> Column:
    """mean | median of a column; exact median (``percentile`` interpolation)."""
    x = _c(c)
    return F.avg(x) if how == "mean" else F.median(x)


def zero_if_null(c) -> Column:
    """The reference's helpers return 0 for empty input."""
    return F.coalesce(_c(c), F.lit(0.0))


def js_round(c) -> Column:
    """JavaScript ``Math.round``: half rounds up (towards +inf)."""
    return F.floor(_c(c) + 0.5)


def complete_bins(agg: DataFrame, bin_col: str, labels: Sequence[str],
                  fill: dict[str, object]) -> DataFrame:
    """Right join a grouped frame to its full bin list (1..len(labels)) so empty
    bins appear with their fill values. The bin list is a literal of fixed size.

    Rows outside every bin form a NULL group that the join drops. Callers do
    not filter on the bin expression before grouping: such a filter would be
    pushed below the projections with the whole measure expression inlined
    once per edge."""
    spark = agg.sparkSession
    all_bins = spark.range(1, len(labels) + 1).select(
        F.col("id").cast("int").alias(bin_col))
    out = F.broadcast(all_bins).join(agg, bin_col, "left")
    out = out.withColumn(f"{bin_col}_label", label_of(F.col(bin_col), labels))
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})
