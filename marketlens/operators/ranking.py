"""First-per-key, top fractions, global ranks, top-k, splits and samples
(W-01..W-04, SRT-01..04, SP-01..04).

Scale notes
-----------
* ``first_per_key`` is ``row_number() = 1`` over the key; Spark plans a
  partial ``WindowGroupLimit`` before the shuffle, so even a key holding a
  third of all rows leaves each map task as one row.
* ``global_ordinal_rank`` never plans a single-partition window: it range
  partitions and sorts, takes each row's place from that and adds per-partition
  offsets (a tiny frame, one row per partition, broadcast by construction).
* ``top_fraction`` never ranks a whole cell: a histogram of the measure
  (grouped, map-side combined) finds the cut-off value; only rows tied at
  the cut-off are ranked, by a per-value window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import ensure_checkpoint_dir


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def first_per_key(df: DataFrame, key: Sequence[str] | str, order: Sequence) -> DataFrame:
    """W-01: keep the first row per key by an explicit order (not dropDuplicates)."""
    key = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*key).orderBy(*_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_fraction_exact(df: DataFrame, cell: Sequence[str], measure: str, tie: Sequence[str],
                       fraction: float = 0.1) -> DataFrame:
    """W-02: per cell keep exactly greatest(1, floor(n*fraction)) rows, largest
    measure first, ties by ``tie`` ascending (pandas ``nlargest`` keeps earliest).

    Plan: (1) histogram (cell, measure) -> count, map-side combined; (2) running
    count from the top per cell on that small frame gives one cut-off value per
    cell and how many tied rows are still needed; (3) rows meet their cell's
    cut-off (one row per cell), and only rows tied at it are ranked.
    """
    cell = list(cell)
    cut = cut_offs(df.groupBy(*cell, measure).agg(F.count(F.lit(1)).alias("_cnt")), cell, measure, "_cnt", fraction)
    cut = cut.select(*[F.col(c).alias(f"_cell{i}") for i, c in enumerate(cell)], F.col("cut").alias("_cut"), F.col("need").alias("_need"))
    # null-safe join on the cell (a category may be NULL)
    cond = [df[c].eqNullSafe(cut[f"_cell{i}"]) for i, c in enumerate(cell)] + [df[measure] >= cut["_cut"]]
    joined = df.join(cut, cond).select(df["*"], F.when(df[measure] == cut["_cut"], cut["_need"]).alias("_need"))
    above = joined.where(F.col("_need").isNull())
    # rows tied at the cut-off: ordinal rank by the tie key within the cell,
    # range-partitioned, so a cell whose tie holds most rows is still spread
    tied = global_ordinal_rank(joined.where(F.col("_need").isNotNull()), tie, "_r", group=cell)
    kept = tied.where(F.col("_r") <= F.col("_need")).drop("_r")
    return above.unionByName(kept).drop("_need")


def cut_offs(hist: DataFrame, cell: Sequence[str], measure: str, count: str, fraction: float = 0.1) -> DataFrame:
    """Per cell of a histogram (cell, measure, count): ``cut``, the value of the row at place
    greatest(1, floor(n*fraction)) from the top, and ``need``, how many of the rows of that value are
    within the places (null if all of them)."""
    wc = Window.partitionBy(*cell)
    wdesc = wc.orderBy(F.col(measure).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = (hist.withColumn("_k", F.greatest(F.lit(1), F.floor(F.sum(count).over(wc) * F.lit(fraction))))
            .withColumn("_cum", F.sum(count).over(wdesc)).withColumn("_before", F.col("_cum") - F.col(count)))
    return (hist.where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_cum")))
            .select(*cell, F.col(measure).alias("cut"), F.when(F.col("_k") < F.col("_cum"), F.col("_k") - F.col("_before")).alias("need")))


def kth_largest_threshold(df: DataFrame, cell: Sequence[str], measure: str,
                          fraction: float = 0.1) -> DataFrame:
    """W-04: per cell, value at rank k = greatest(1, floor(n*fraction)) from the top
    (sorted descending), from a cumulative histogram. One row per cell."""
    cell = list(cell)
    hist = df.groupBy(*cell, measure).agg(F.count(F.lit(1)).alias("_cnt"))
    return cut_offs(hist, cell, measure, "_cnt", fraction).select(*cell, F.col("cut").alias("threshold"))


def global_ordinal_rank(df: DataFrame, order: Sequence, rank_col: str = "rank",
                        num_partitions: int | None = None,
                        group: Sequence[str] = ()) -> DataFrame:
    """W-03: 1..n ordinal rank over the whole table (or within each ``group``)
    without a window that puts a whole table or group in one partition.

    ``order`` must be a total order (add a unique tie-break column). Rows are
    range-partitioned on (group, order), so a large group spreads over many
    partitions, and sorted there; ``monotonically_increasing_id`` then holds
    each row's partition and place, so numbering needs no further exchange.
    What is added are offsets from the (group, partition) counts: one row per
    partition a group touches. The frame is checkpointed to the shared
    checkpoint folder, so places are stable between counting and numbering,
    and a lost executor recomputes from the checkpoint.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = list(group)
    keys = [*_cols(group), *_cols(order)]
    parted = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_place", F.monotonically_increasing_id())).checkpoint(eager=True)
    pid, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    parted = parted.withColumn("_pid", pid).withColumn("_place", place)
    counts = (parted.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_pid").alias("_opid"))
              .agg(F.count(F.lit(1)).alias("_pc"), F.min("_place").alias("_first")))
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_opid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_pc").over(before), F.lit(0)) - F.col("_first") + 1).drop("_pc", "_first")
    cond = [parted["_pid"] == offsets["_opid"]] + \
        [parted[c].eqNullSafe(offsets[f"_g{i}"]) for i, c in enumerate(group)]
    # offsets: one row per (group, partition touched); without groups at most
    # n rows, so it is broadcast; with groups it is joined by key
    joined = parted.join(offsets if group else F.broadcast(offsets), cond)
    return (joined.withColumn(rank_col, (F.col("_off") + F.col("_place")).cast("bigint"))
            .drop("_pid", "_place", "_off", "_opid", *[f"_g{i}" for i in range(len(group))]))


def top_k(df: DataFrame, k: int, order: Sequence) -> DataFrame:
    """SRT-02: top-k by an order with a tie-break -> TakeOrderedAndProject."""
    return df.orderBy(*_cols(order)).limit(k)


def per_group_cap(df: DataFrame, group: Sequence[str], k: int, order: Sequence) -> DataFrame:
    """SRT-03 per-category cap: row_number <= k (partial WindowGroupLimit before shuffle)."""
    w = Window.partitionBy(*group).orderBy(*_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def stable_hash(key: str, seed: int) -> Column:
    """The first 8 hex digits of md5("key:seed") as a number: the same in every SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("bigint")


def hash_split(df: DataFrame, key: str, seed: int = 42,
               fractions: Sequence[float] = (0.70, 0.15, 0.15),
               names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """SP-01: deterministic split column from ``stable_hash(key, seed)`` modulo 100.

    Stable under repartitioning and executor loss (unlike randomSplit)."""
    bucket = F.pmod(stable_hash(key, seed), F.lit(100))
    edges, acc = [], 0.0
    for f in fractions:
        acc += f
        edges.append(round(acc * 100))
    expr = None
    for e, name in zip(edges, names):
        expr = F.when(bucket < e, name) if expr is None else expr.when(bucket < e, name)
    return df.withColumn("split", expr.otherwise(names[-1]))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """SP-02/03/04: n rows chosen by a seeded hash of the key (reproducible)."""
    return df.orderBy(stable_hash(key, seed), F.col(key)).limit(n)
