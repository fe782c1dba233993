"""Listing-completeness questions (AG-29..AG-37) over ``plans.frames.quality_frame``.

Cells are (category | ALL) x (segment | ALL).

* Additive measures (field presence counts, missing sums) are aggregated to
  (category, segment) first and the small result is cubed: the cube's x4 row
  expansion never touches the raw rows.
* Listings collapse to a multiset first: counts of (category, segment, sales,
  presence bits) or (category, segment, missing, sales). Cells, cut-offs, bins,
  medians and shares come from those counts; only the collapsed rows are
  expanded to the four cells. Rows are touched again for the per-cell top 10 %
  alone, and there only those tied at a cell's cut-off value.
* The adaptive missing-count bins are an order-dependent fold; it is an
  ``aggregate`` over the per-cell histogram (at most 35 values), never over
  listing rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.bins import SEGMENT_LABELS, label_of
from marketlens.operators.joins import dimension_frame, lookup_join
from marketlens.operators.ranking import cut_offs, global_ordinal_rank

ALL = "ALL"
CELL = ["cell_category", "cell_segment"]
ROW_TIE = ["row_k1", "row_k2", "row_k3", "asin"]


def _flags(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("has_")]


def _seg_label(c: Column) -> Column:
    return label_of(c, SEGMENT_LABELS)


def field_display_names(long: DataFrame, names: Mapping[str, str],
                        field_col: str = "field") -> DataFrame:
    """FE-27: display name per field from a fixed dictionary, raw name when unmapped."""
    dim = dimension_frame(long.sparkSession, names, field_col, "field_name")
    return lookup_join(long, dim, field_col, "field_name", default=F.col(field_col),
                       dim_rows=len(names))


def _cube_cells(df: DataFrame, sums: list[str]) -> DataFrame:
    """Pre-aggregate to (category, segment), then cube the small result."""
    pre = df.groupBy("category", "segment").agg(
        F.count(F.lit(1)).alias("listings"), *[F.sum(F.col(c).cast("long")).alias(c) for c in sums])
    cub = pre.cube("category", "segment").agg(
        F.grouping_id().alias("_gid"), F.sum("listings").alias("listings"),
        *[F.sum(c).alias(c) for c in sums])
    return cub.select(
        F.when((F.col("_gid").bitwiseAND(2)) > 0, F.lit(ALL)).otherwise(F.col("category"))
        .alias("cell_category"),
        F.when((F.col("_gid").bitwiseAND(1)) > 0, F.lit(ALL)).otherwise(_seg_label(F.col("segment")))
        .alias("cell_segment"),
        "listings", *sums)


def _long_fields(cells: DataFrame, flags: list[str]) -> DataFrame:
    long = cells.unpivot([*CELL, "listings"], flags, "field", "provided")
    return long.select(*CELL, F.regexp_replace("field", "^has_", "").alias("field"),
                       "listings", F.col("provided").cast("bigint").alias("provided"),
                       (F.col("provided") * 100.0 / F.col("listings")).alias("provided_pct"))


def provided_by_cell(df: DataFrame) -> DataFrame:
    """AG-29: per cell and field, listings providing the field and the share (%)."""
    flags = _flags(df)
    return _long_fields(_cube_cells(df, flags), flags)


def listings_by_cell(df: DataFrame) -> DataFrame:
    """J-07: listings per cell, from counts by category and segment."""
    return _cube_cells(df, []).where(F.col("cell_category").isNotNull())


def explode_cells(df: DataFrame) -> DataFrame:
    """Each (collapsed) row once per cell it belongs to: (cat, seg), (cat, ALL), (ALL, seg), (ALL, ALL);
    a row without category only in the last two."""
    seg = _seg_label(F.col("segment"))
    cells = F.array(
        F.struct(F.col("category").alias("c"), seg.alias("s")),
        F.struct(F.col("category").alias("c"), F.lit(ALL).alias("s")),
        F.struct(F.lit(ALL).alias("c"), seg.alias("s")),
        F.struct(F.lit(ALL).alias("c"), F.lit(ALL).alias("s")))
    return (df.withColumn("_cell", F.explode(F.filter(cells, lambda c: c["c"].isNotNull())))
            .withColumn("cell_category", F.col("_cell.c"))
            .withColumn("cell_segment", F.col("_cell.s")).drop("_cell"))


def _cell_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Listings (n) of each cell and value of ``keys``: counted by category and segment first."""
    collapsed = df.groupBy("category", "segment", *keys).agg(F.count(F.lit(1)).alias("n"))
    return explode_cells(collapsed).groupBy(*CELL, *keys).agg(F.sum("n").alias("n"))


def top_provided_by_cell(df: DataFrame, fraction: float = 0.1) -> DataFrame:
    """AG-30: AG-29 restricted to the top 10 % by sales of each cell
    (exactly max(1, floor(n*0.1)) rows, ties -> earliest row)."""
    flags = _flags(df)
    bits = sum((F.when(F.col(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(flags)), F.lit(0)).cast("bigint")
    held = lambda i: F.shiftright("bits", i).bitwiseAND(1)
    marked = df.select(*ROW_TIE, "category", "segment", "sales", bits.alias("bits"))
    counts = _cell_counts(marked, ["sales", "bits"])
    cut = cut_offs(counts.groupBy(*CELL, "sales").agg(F.sum("n").alias("cnt")), CELL, "sales", "cnt", fraction)
    whole = (F.col("sales") > F.col("cut")) | ((F.col("sales") == F.col("cut")) & F.col("need").isNull())
    above = counts.join(cut, CELL).where(whole).groupBy(*CELL).agg(
        F.sum("n").alias("listings"), *[F.sum(F.col("n") * held(i)).alias(c) for i, c in enumerate(flags)])
    # listings at the cut-off of a cell of theirs: the first of them by row order are still needed
    tied = cut.where("need is not null").withColumnRenamed("cut", "_cut")
    mine = ((F.col("sales") == F.col("_cut")) & F.col("cell_category").isin(ALL, F.col("category"))
            & F.col("cell_segment").isin(ALL, _seg_label(F.col("segment"))))
    ranked = global_ordinal_rank(marked.join(tied, mine).select(*CELL, *ROW_TIE, "need", "bits"), ROW_TIE, "_r", group=CELL)
    rest = ranked.where(F.col("_r") <= F.col("need")).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("listings"), *[F.sum(held(i)).alias(c) for i, c in enumerate(flags)])
    both = above.unionByName(rest).groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in ["listings", *flags]])
    return _long_fields(both, flags)


def _joined(df: DataFrame) -> DataFrame:
    a = provided_by_cell(df).where(F.col("cell_category").isNotNull())
    t = top_provided_by_cell(df)
    return a.alias("a").join(t.alias("t"), [*CELL, "field"]).select(
        *CELL, "field", F.col("a.listings").alias("listings"),
        F.col("a.provided").alias("all_provided"), F.col("t.provided").alias("top_provided"),
        F.col("a.provided_pct").alias("all_pct"), F.col("t.provided_pct").alias("top_pct"))


def field_lift(df: DataFrame, k: int = 7) -> DataFrame:
    """AG-31: lift = top % - all % per cell and field; the k largest per cell
    (ties by field), plus the headline field (largest lift among fields with
    top % > 5, shown when its lift > 0.1)."""
    j = _joined(df).withColumn("lift", F.col("top_pct") - F.col("all_pct"))
    w = Window.partitionBy(*CELL)
    ranked = j.withColumn("lift_rank", F.row_number().over(w.orderBy(F.col("lift").desc(), "field")))
    head = F.row_number().over(w.orderBy((F.col("top_pct") > 5).desc(), F.col("lift").desc(), "field"))
    ranked = ranked.withColumn("is_headline", (head == 1) & (F.col("top_pct") > 5)
                               & (F.col("lift") > 0.1))
    return ranked.where((F.col("lift_rank") <= k) | F.col("is_headline")) \
        .select(*CELL, "field", "top_pct", "all_pct", "lift", "lift_rank", "is_headline")


def field_concentration(df: DataFrame, k: int = 7) -> DataFrame:
    """AG-32: share of a field's listings that sit in the cell's top 10 %, for
    fields provided by at least max(10, 1 % of the cell); the k largest."""
    j = _joined(df).where(F.col("all_provided") >= F.greatest(F.lit(10.0), F.col("listings") * 0.01))
    j = j.withColumn("concentration_pct", F.col("top_provided") * 100.0 / F.col("all_provided"))
    w = Window.partitionBy(*CELL).orderBy(F.col("concentration_pct").desc(), "field")
    return (j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(*CELL, "field", "top_provided", "all_provided", "concentration_pct",
                    (F.col("concentration_pct") / 10).alias("uplift"), "rank"))


def mean_missing_by_cell(df: DataFrame) -> DataFrame:
    """AG-33: mean number of missing fields per cell."""
    cells = _cube_cells(df, ["missing_count"])
    return cells.select(*CELL, "listings",
                        (F.col("missing_count") / F.col("listings")).alias("missing_mean"))


# ---------------------------------------------------------------------------
# Adaptive missing-count bins (AG-34..AG-37)
# ---------------------------------------------------------------------------

# Missing counts from 34 on are one key; values that start a bin;
# at most 7 bins; a bin closes when the next value would take it over 1.5 times
# an even share, or when it holds more than 0.7 of one; "29" joins "30" or "30-31".
POOL_FROM, POOLED_KEY = 34, 999
STARTS_BIN = (15, 18, 28, POOLED_KEY)
MAX_BINS, OVER, ENOUGH = 7, 1.5, 0.7
LONE, NEIGHBOUR, NEIGHBOUR_ENDS = 29, 30, (30, 31)


def _histogram(df: DataFrame) -> DataFrame:
    """Listings (n) of each cell, missing-count key, missing count and (where there is one) sales."""
    counts = _cell_counts(df, ["missing_count", *(["sales"] if "sales" in df.columns else [])])
    mkey = F.when(F.col("missing_count") >= POOL_FROM, F.lit(POOLED_KEY)) \
        .otherwise(F.col("missing_count")).cast("int")
    return counts.withColumn("mkey", mkey)


def _bin_starts(values: Column, share: Column) -> Column:
    """First keys of the bins over the ordered histogram ``values`` (mkey, cnt)."""
    def step(acc: Column, x: Column) -> Column:
        closes = (F.size(acc["starts"]) < MAX_BINS) & (
            (acc["held"] + x["cnt"] > share * OVER) | (acc["held"] > share * ENOUGH) | x["mkey"].isin(*STARTS_BIN))
        opens = (F.size(acc["starts"]) == 0) | closes
        return F.struct(F.when(opens, x["cnt"]).otherwise(acc["held"] + x["cnt"]).alias("held"),
                        F.when(opens, F.concat(acc["starts"], F.array(x["mkey"]))).otherwise(acc["starts"]).alias("starts"))

    empty = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(values, empty, step, lambda acc: acc["starts"])


def adaptive_bins(df: DataFrame) -> DataFrame:
    """AG-34: per cell, mapping missing-count key -> adaptive bin (index, label).

    Spark builds the per-cell histogram (grouped, map-side combined); the bins are
    a fold over its at most 35 ordered values, their extents windows over the same rows.
    """
    return _bins_of(_histogram(df))


def _bins_of(counts: DataFrame) -> DataFrame:
    hist = (counts.groupBy(*CELL, "mkey")
            .agg(F.sum("n").alias("cnt"), F.min("missing_count").alias("vmin"),
                 F.max("missing_count").alias("vmax")))
    cells = hist.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("mkey", "cnt", "vmin", "vmax"))).alias("values"),
                                    (F.sum("cnt") / MAX_BINS).alias("share"))
    rows = (cells.withColumn("starts", _bin_starts(F.col("values"), F.col("share")))
            .select(*CELL, "starts", F.explode("values").alias("v")).select(*CELL, "starts", "v.*")
            .withColumn("nth", F.size(F.filter("starts", lambda s: s <= F.col("mkey")))))
    extent = Window.partitionBy(*CELL, "nth")
    rows = rows.withColumn("lo", F.min("vmin").over(extent)).withColumn("hi", F.max("vmax").over(extent))
    # the lone bin is followed by the neighbour: both get one label, later bins move up
    cell = Window.partitionBy(*CELL)
    lone = F.max(F.when((F.col("lo") == LONE) & (F.col("hi") == LONE), F.col("nth"))).over(cell)
    next_ = F.max(F.when((F.col("lo") == NEIGHBOUR) & F.col("hi").isin(*NEIGHBOUR_ENDS), F.col("nth"))).over(cell)
    joined = F.coalesce(next_ == lone + 1, F.lit(False))
    label = (F.when(F.col("_joined") & F.col("nth").isin(F.col("_lone"), F.col("_lone") + 1), F.lit(f"{LONE}-{NEIGHBOUR_ENDS[-1]}"))
             .when(F.col("lo") >= POOL_FROM, F.lit(f"{POOL_FROM}+"))
             .when(F.col("lo") == F.col("hi"), F.col("lo").cast("string"))
             .otherwise(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string"))))
    moved = F.col("nth") - F.when(F.col("_joined") & (F.col("nth") > F.col("_lone")), 1).otherwise(0)
    return (rows.withColumn("_lone", lone).withColumn("_joined", joined)
            .select(*CELL, "mkey", moved.cast("int").alias("bin"), label.alias("bin_label")))


def sales_by_missing_bin(df: DataFrame) -> DataFrame:
    """AG-35: listings and sales mean & median per adaptive bin, from weighted sales values."""
    counts = _histogram(df)
    return (counts.join(_bins_of(counts), [*CELL, "mkey"]).groupBy(*CELL, "bin", "bin_label")
            .agg(F.sum("n").alias("listings"), (F.sum(F.col("sales") * F.col("n")) / F.sum("n")).alias("sales_mean"),
                 F.percentile("sales", 0.5, F.col("n")).alias("sales_median")))


def best_vs_worst_bin(df: DataFrame, how: str = "mean") -> DataFrame:
    """AG-36: rounded sales of the first (fewest missing) bin minus the last bin's."""
    s = sales_by_missing_bin(df).withColumn(
        "bin_sales", F.floor(F.col(f"sales_{how}") + 0.5).cast("bigint"))
    return s.groupBy(*CELL).agg(
        F.min_by("bin_sales", "bin").alias("best_sales"),
        F.max_by("bin_sales", "bin").alias("worst_sales"),
        F.count(F.lit(1)).alias("bins")).withColumn(
        "difference", F.col("best_sales") - F.col("worst_sales"))


def top_decile_share_by_bin(df: DataFrame, fraction: float = 0.1) -> DataFrame:
    """AG-37: per adaptive bin, share (%) of listings at or above the cell's
    top-decile sales threshold (W-04, ties kept) with sales > 0."""
    counts = _histogram(df)
    th = cut_offs(counts.groupBy(*CELL, "sales").agg(F.sum("n").alias("cnt")), CELL, "sales", "cnt", fraction).select(*CELL, "cut")
    b = counts.join(_bins_of(counts), [*CELL, "mkey"]).join(th, CELL)
    top = (F.col("sales") >= F.col("cut")) & (F.col("sales") > 0)
    return (b.groupBy(*CELL, "bin", "bin_label")
            .agg(F.sum("n").alias("listings"), F.coalesce(F.sum(F.when(top, F.col("n"))), F.lit(0)).alias("top_listings"))
            .withColumn("top_pct", F.col("top_listings") * 100.0 / F.col("listings"))
            .withColumn("uplift", F.col("top_pct") / 10))
