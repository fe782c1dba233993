"""Mixing sources to target weights by a low-discrepancy schedule (operator 1).

Each source gets a target of words. The mix is a sequence of blocks of equal size; van der Corput
points, mapped through the sources' cumulative shares, say which source fills which slot. A
source's k-th slot takes the k-th block of its shuffled documents, read in a circle. All steps are
DataFrame operations; running sums and ranks go by buckets, so a source of any size spreads out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, WORD, checkpointed

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix against all words, and the most against a source's own.
SHARE, MOST = 1.5, 2.0
#: Words of one block.
BLOCK_WORDS = 1024
#: Cells of the schedule's lookup of a source by position; slots spread evenly over them.
CELLS = 1024
#: Slots ranked together.
SLOT_CHUNK = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets of the rows (source, source_size, n): adds ix, target, quota (whole words).

    The level of words per unit of weight is the highest of the levels that remain when the
    sources that fill first (smallest size per weight) stop at ``most`` times their size.
    One row per source goes through one task here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("ix") - 1) % len(weights) + 1).cast("int")).cast("double")
    fills = Window.orderBy("_cap_per_weight", "ix").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ahead = lambda c: F.coalesce(F.sum(c).over(fills), F.lit(0.0))
    return (sizes.withColumn("ix", F.row_number().over(by_name)).withColumn("_weight", weight)
            .withColumn("_cap", F.col("source_size") * F.lit(most)).withColumn("_cap_per_weight", F.col("_cap") / F.col("_weight"))
            .withColumn("_level", (F.sum("source_size").over(everything) * F.lit(share) - ahead("_cap"))
                        / (F.sum("_weight").over(everything) - ahead("_weight")))
            .withColumn("target", F.least("_cap", F.max("_level").over(everything) * F.col("_weight")))
            .withColumn("quota", F.floor("target"))
            .drop("_weight", "_cap", "_cap_per_weight", "_level"))


@dataclass
class Mix:
    """``rows``: the given rows with ix, place, start (words of the source's stream before it) and
    their source's numbers; ``schedule``: slot, ix, block of every slot."""

    rows: DataFrame
    schedule: DataFrame
    block: int

    def pieces(self) -> DataFrame:
        """Each stretch of a document in a block, with its slot (null for rows not taken):
        the columns of ``rows`` and slot, from_word, words."""
        first = F.col("start") + F.col("pass") * F.col("source_size")
        end = F.least(first + F.col("size"), F.col("quota"))
        passes = F.when(F.col("quota") > F.col("start"), F.sequence(F.lit(0), F.floor((F.col("quota") - F.col("start") - 1) / F.greatest("source_size", F.lit(1)))))
        blocks = F.when(F.col("_end") > F.col("_first"), F.sequence(F.floor(F.col("_first") / self.block), F.floor((F.col("_end") - 1) / self.block)))
        cut = (self.rows.withColumn("pass", F.explode_outer(passes)).withColumn("_first", first).withColumn("_end", end)
               .withColumn("block", F.explode_outer(blocks))
               .withColumn("_from", F.greatest("_first", F.col("block") * self.block))
               .withColumn("words", F.least("_end", (F.col("block") + 1) * self.block) - F.col("_from"))
               .withColumn("from_word", F.col("_from") - F.col("_first")).drop("_first", "_end", "_from"))
        return cut.join(self.schedule, ["ix", "block"], "left")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
         block: int = BLOCK_WORDS, keep: dict[str, Column] | None = None) -> Mix:
    """Schedule a mix of ``docs`` (doc_id, text, source); ``keep`` adds columns to the rows.

    A null text has no words; a null source is a source, the last. Rows with no words, and sources
    without any, are not taken. The shuffle orders rows by the md5 of the id, then size: rows with
    the same id and size (also null ids) are in either order, which changes nothing but which of
    the equals is cut. Other columns are ignored. An empty table gives an empty mix.
    """
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = checkpointed(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"),
                                    hashed.alias("hash"), *[c.alias(k) for k, c in (keep or {}).items()]))
    per_source = checkpointed(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, most))
    total = per_source.agg(F.sum("n").alias("n"), F.sum(F.ceil(F.col("quota") / block)).alias("blocks")).first()
    digits = max(0, math.ceil(math.log(max(1, (total["n"] or 0) / BUCKET_ROWS), 16)))
    stated = F.broadcast(per_source) if per_source.count() <= 10_000 else per_source
    rows = (rows.withColumnRenamed("source", "_s").join(stated.withColumnRenamed("source", "source"), F.col("_s").eqNullSafe(F.col("source")))
            .drop("_s", "n").withColumn("bucket", F.substring("hash", 1, digits)))
    before = Window.partitionBy("ix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("ix", "bucket").agg(F.sum("size").alias("_words"))
              .withColumn("_ahead", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words"))
    inside = Window.partitionBy("ix", "bucket").orderBy("hash", "size")
    rows = (rows.withColumn("place", F.row_number().over(inside))
            .withColumn("_inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
            .join(starts, ["ix", "bucket"]).withColumn("start", F.col("_ahead") + F.col("_inside")).drop("_ahead", "_inside", "hash"))
    return Mix(rows, schedule(per_source, int(total["blocks"] or 0), block), block)


def schedule(per_source: DataFrame, slots: int, block: int) -> DataFrame:
    """slot, ix, block: which block of which source each slot takes.

    Slot i lies at the position of i with its binary digits reversed, as a share of all blocks.
    Over a power of two of slots, at least as many as blocks, every position is met once or twice,
    so each source meets at least its blocks; further slots of a source are left out.
    """
    digits = max(0, slots - 1).bit_length()
    size = 1 << digits
    mine = F.ceil(F.col("quota") / block)
    before = Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    cell = lambda c: F.floor(c.cast("decimal(19,0)") * CELLS / max(1, slots))
    spans = (per_source.where("quota > 0").select("ix", mine.alias("blocks"))
             .withColumn("lo", F.coalesce(F.sum("blocks").over(before), F.lit(0))).withColumn("hi", F.col("lo") + F.col("blocks"))
             .withColumn("cell", F.explode(F.sequence(cell(F.col("lo")).cast("long"), cell(F.col("hi") - 1).cast("long")))))
    reversed_ = F.conv(F.reverse(F.lpad(F.bin("id"), digits, "0")), 2, 10) if digits else F.lit("0")
    at = F.expr(f"cast(turned as decimal(19,0)) * cast({slots} as decimal(19,0)) div {size}")
    points = (per_source.sparkSession.range(size if slots else 0).withColumn("turned", reversed_.cast("long"))
              .select(F.col("id").alias("slot"), at.cast("long").alias("at")).withColumn("cell", cell(F.col("at")).cast("long")))
    met = (points.join(spans, "cell").where("at >= lo and at < hi").select("slot", "ix", "blocks")
           .withColumn("chunk", F.floor(F.col("slot") / SLOT_CHUNK)))
    ahead = Window.partitionBy("ix").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = met.groupBy("ix", "chunk").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("ix", "chunk").orderBy("slot"))
    return (met.withColumn("_place", place).join(starts, ["ix", "chunk"])
            .withColumn("block", F.col("_ahead") + F.col("_place") - 1).where("block < blocks").select("slot", "ix", "block"))


def taken(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words of the mix) of every row."""
    mix = plan(docs, **settings)
    words = F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0))
    return (mix.pieces().groupBy("ix", "bucket", "place", "doc_id", "source", "size", "source_size", "target")
            .agg(words.alias("taken")).select("doc_id", "source", "size", "source_size", "target", "taken"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, a whole document once for each pass that takes a word of it.

    Rows that agree in doc_id, source and text count as copies of one document; the columns of
    ``docs`` are unchanged.
    """
    key = [F.col("doc_id"), F.col("source").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))]
    names = ["doc_id", "source", "print"]
    mix = plan(docs, keep={"print": key[2]}, **settings)
    times = (mix.pieces().where("slot is not null").groupBy(*names, "bucket", "place", "pass").agg(F.min("slot"))
             .groupBy(*names).agg(F.count(F.lit(1)).cast("int").alias("times")))
    whole = docs.select(*[k.alias(n) for k, n in zip(key, names, strict=True)], F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    whole = whole.groupBy(*names).agg(F.first("row").alias("row"))
    same = [whole[n].eqNullSafe(times[n]) for n in names]
    return whole.join(times, same).select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
