"""MinHash near-duplicates by bottom-k sketches of one hash function (operator 9).

A document's set holds the hashes of its five-word shingles; its sketch is the smallest BOTTOM of
them. Inverted lists of retained values generate overlaps: in one common order of values, rarest
first, two sketches that share at least ``need`` values share one among the first size - need + 1 of
either, so a document is listed under its rarest values alone. Values of passages, lines and
templates that many documents hold come last and seldom have a list. Pairs that meet are estimated
on the sketch of their union and confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import checkpointed, give_back, shipped, written
from .components import components

SHINGLE = 5
PERCENT = 75
BOTTOM = 96
#: Counters of the common order: a value's place depends on the documents that share its counter.
COUNTERS = 1 << 18
#: Least estimate of a pair that goes on to its full sets: 4.5 standard errors below the threshold.
LEAST_ESTIMATE = 0.55
#: Bits of the map of wanted ids, which each task holds.
WANTED_BITS = 1 << 25
#: Longest list of which all pairs are taken; longer ones are refined.
SHORT_LIST = 24
#: Members of a long list compared at once.
BLOCK = 512


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, end to end, and the rows' offsets."""
    rows = len(offs) - 1
    lower = ts.LOWER[data]
    start, end, row = ts.word_spans(lower, offs)
    words = ts.span_hash(ts.byte_prefix(lower), start, end)
    first, h = ts.windows(words, row, SHINGLE)
    count = np.bincount(row, minlength=rows)
    before = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    whole = [ts.windows(words[before[i] : before[i + 1]], np.zeros(count[i], int), int(count[i]))[1][0] for i in short.tolist()]
    h = np.concatenate([h, np.array(whole, np.uint64)]) >> np.uint64(1)
    row = np.concatenate([row[first], short])
    order = np.argsort(row, kind="stable")
    h, bounds = h[order], np.searchsorted(row[order], np.arange(rows + 1))
    keep = np.ones(len(h), bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
            keep[a + 1 : b] = h[a + 1 : b] != h[a : b - 1]
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def needed(size: np.ndarray) -> np.ndarray:
    """Retained values that a sketch of ``size`` must share with a partner's: three quarters of it where
    all partners are whole sets too (they hold at most 4 / 3 as many shingles), else what the least
    estimate asks of a union's sketch, which is less from there on."""
    least = int(np.ceil(LEAST_ESTIMATE * BOTTOM))
    return np.minimum(-(-PERCENT * size // 100), least)


def rarest(sketch: np.ndarray, bounds: np.ndarray, counts: np.ndarray, need: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The values under which each row is listed, end to end, and offsets."""
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((sketch, counts[sketch % np.uint64(COUNTERS)], row))
    listed = np.where(size > 0, size - (needed(size) if need is None else need) + 1, 0)
    place = np.arange(len(sketch)) - bounds[row]
    return sketch[order][place < listed[row]], np.concatenate([[0], np.cumsum(listed)])


def _ragged(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _print(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """128 bits of each whole set."""
    both = np.stack([_sums(ts.mix(h), bounds), _sums(ts.mix(~h), bounds)], axis=1)
    out = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(bounds) - 1, [None, pa.py_buffer(both.astype(">u8").tobytes())])
    return out.cast(pa.binary())


def _read(docs: DataFrame, schema: str, columns: Callable[[np.ndarray, np.ndarray], dict[str, pa.Array]], wanted: Callable[[], np.ndarray] | None = None, mark: bool = False) -> DataFrame:
    """doc_id and the given columns of the sets of every row, or of those whose bit is in ``wanted``;
    with ``mark``, of every row and whether its bit is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = wanted() if wanted else None
        for b in batches:
            if wanted:
                bit = b.column(2).to_numpy()
                there = pa.array((held[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1)
                b = b if mark else b.filter(there)
            for lo, hi, data, offs in ts.text_slices(b.column(1)):
                got = columns(*shingle_sets(data, offs)) | ({"marked": there.slice(lo, hi - lo)} if mark else {})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *got.values()], ["doc_id", *got])
        give_back()

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id, F.col("text").cast("string"), *([_bit(doc_id)] if wanted else [])).mapInArrow(run, f"doc_id long, {schema}")


def _bit(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(WANTED_BITS))


def _map_of(ids: DataFrame) -> Callable[[], np.ndarray]:
    """A bit map of a fixed size that holds the ids (doc_id) and, by chance, a few others, so that
    texts need no shuffle to find those that are wanted."""
    bit = ids.where("doc_id is not null").select(_bit(F.col("doc_id")).alias("bit"))
    words = bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 64))")).alias("bits")).toPandas()
    out = np.zeros(WANTED_BITS // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return shipped(ids.sparkSession, out)


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, print of every row."""
    return _read(docs, "n_shingles long, print binary", lambda h, bounds: {"n_shingles": pa.array(np.diff(bounds)), "print": _print(h, bounds)})


def sketches(docs: DataFrame, held: Callable[[], np.ndarray]) -> DataFrame:
    """doc_id, n_shingles, print, sketch of every row, and whether its bit is in the map ``held``."""

    def columns(h: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
        kept = np.minimum(np.diff(bounds), BOTTOM)
        at = np.concatenate([[0], np.cumsum(kept)])
        sketch = h[np.arange(at[-1]) + np.repeat(bounds[:-1] - at[:-1], kept)]
        return {"n_shingles": pa.array(np.diff(bounds)), "print": _print(h, bounds), "sketch": _ragged(sketch, at)}

    return _read(docs, "n_shingles long, print binary, sketch array<long>, marked boolean", columns, held, mark=True)


def representatives(docs: DataFrame, named: DataFrame) -> DataFrame:
    """id, n, print, sketch: the smallest id of each class of ``named`` (doc_id, n_shingles, print).

    A row that is alone in its class needs no join. The ids of classes of more rows lie in a map of a
    fixed size, and only rows whose bit is set are shuffled to find the one that stands for a class."""
    first = named.groupBy("n_shingles", "print").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_rows"))
    first = written(first)
    several = first.where("_rows > 1").select("n_shingles", "print")
    held = _map_of(named.join(several, ["n_shingles", "print"], "left_semi").select("doc_id"))

    rows = checkpointed(sketches(docs, held).where("n_shingles > 0 and doc_id is not null"))
    shared = rows.where("marked").drop("marked").join(first.drop("_rows"), ["doc_id", "n_shingles", "print"], "left_semi")
    shared = checkpointed(shared.dropDuplicates(["doc_id", "print"]))
    return (rows.where("not marked").drop("marked").union(shared)
            .select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "print", "sketch"))


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, print and the whole set of the rows with one of the ids (doc_id)."""
    columns = lambda h, bounds: {"print": _print(h, bounds), "shingles": _ragged(h, bounds)}
    ids = written(ids)
    return _read(docs, "print binary, shingles array<long>", columns, _map_of(ids)).join(ids, "doc_id", "left_semi")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offs = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), (offs - offs[0]).astype(np.int64)


def value_counts(lists: DataFrame) -> np.ndarray:
    """How many values of a column of lists fall on each of COUNTERS counters: a table of a fixed size,
    summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            total += np.bincount((_flat(b.column(0))[0] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["counter", "n"])

    found = lists.mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, np.int64)
    out[found["counter"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def postings(classes: DataFrame) -> DataFrame:
    """id, n, key: the lists of each class."""
    shared = shipped(classes.sparkSession, value_counts(classes.select("sketch")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared()
        for b in batches:
            keys, bounds = rarest(*_flat(b.column(2)), counts)
            row = pa.array(np.repeat(np.arange(len(b)), np.diff(bounds)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(keys.view(np.int64))], ["id", "n", "key"])

    return classes.select("id", "n", "sketch").mapInArrow(run, "id long, n long, key long")


def full_postings(sets: DataFrame) -> DataFrame:
    """id, n, key, most: the lists of each row of ``sets`` (doc_id, print, shingles) by its full set.

    Two sets at the threshold share one of the first n - 3 n / 4 + 1 of either in the common order. Where
    a value at place p is the first they share, they share n - p at most, so the other has at most
    ``most`` shingles."""
    shared = shipped(sets.sparkSession, value_counts(sets.select("shingles")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared()
        for b in batches:
            flat, bounds = _flat(b.column(1))
            n = np.diff(bounds)
            keys, at = rarest(flat, bounds, counts, -(-PERCENT * n // 100))
            row = np.repeat(np.arange(len(b)), np.diff(at))
            place = np.arange(len(keys)) - at[row]
            most = (100 + PERCENT) * (n[row] - place) // PERCENT - n[row]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(n[row]), pa.array(keys.view(np.int64)), pa.array(most)], ["id", "n", "key", "most"])

    return sets.select("doc_id", "shingles").mapInArrow(run, "id long, n long, key long, most long")


def _near(n_a: str, n_b: str):
    """The smaller set is large enough for the threshold."""
    return 100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)


def _pairs_of_short(lists: DataFrame) -> DataFrame:
    """All pairs a < b of lists (key, id, n) of at most SHORT_LIST members."""
    members = F.array_sort(F.collect_set(F.struct("id", "n")))
    one = lists.groupBy("key").agg(members.alias("m")).select("m", F.posexplode("m").alias("i", "x"))
    two = one.select("x", F.explode(F.slice("m", F.col("i") + 2, SHORT_LIST)).alias("y"))
    return two.where(_near("x.n", "y.n")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _stars(lists: DataFrame, members: DataFrame, *first: Column) -> DataFrame:
    """Each of ``members`` of a list with one member of it, the least by ``first`` and a hash of the id: the
    lists of a group of copies mostly share their centre, so a member meets few centres."""
    centre = lists.groupBy("key").agg(F.min(F.struct(*first, F.xxhash64("id").alias("h"), "id", "n")).alias("c"))
    return (members.join(centre, "key").where((F.col("id") != F.col("c.id")) & _near("n", "c.n"))
            .select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct())


def _with_length(lists: DataFrame) -> DataFrame:
    """Lists of two members or more, with their length."""
    lengths = lists.groupBy("key").agg(F.count(F.lit(1)).alias("len")).where("len > 1")
    return lists.join(lengths, "key")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose union sketch does not rule them out; ``exact`` if the sketches are whole sets."""
    pairs = written(pairs)
    met = classes.join(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "id", "left_semi")
    met = checkpointed(met.select("id", "n", "print", "sketch"))
    side = lambda x: met.select(*[F.col(c).alias(f"{c}_{x}" if c != "id" else x) for c in met.columns])
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, BOTTOM)
    whole = (F.col("n_a") <= BOTTOM) & (F.col("n_b") <= BOTTOM)
    both = F.size(F.array_intersect("sketch_a", "sketch_b"))
    est = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union)) / F.size(union)
    sure = 100 * both >= PERCENT * (F.col("n_a") + F.col("n_b") - both)
    return (pairs.join(side("a"), "a").join(side("b"), "b").withColumn("exact", whole)
            .where(F.when(whole, sure).otherwise(est >= LEAST_ESTIMATE)).select("a", "b", "print_a", "print_b", "exact"))


def _confirmed(docs: DataFrame, near: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Links (a, b) among the pairs: those whose full sets, read unless given, reach the threshold."""
    near = checkpointed(near)
    open_ = near.where(~F.col("exact"))
    if sets is None:
        sets = full_sets(docs, open_.select(F.col("a").alias("doc_id")).union(open_.select("b")).distinct())
    side = lambda x: sets.groupBy(F.col("doc_id").alias(x), F.col("print").alias(f"print_{x}")).agg(F.first("shingles").alias(f"set_{x}"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    full = (open_.join(side("a"), ["a", "print_a"]).join(side("b"), ["b", "print_b"])
            .where(100 * shared >= PERCENT * (F.size("set_a") + F.size("set_b") - shared)))
    return near.where("exact").select("a", "b").union(full.select("a", "b"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ids are in different components."""
    side = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"_{x}"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select(pairs.columns)


def _still_open(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Ids (doc_id) of the lists whose members are not all linked by now."""
    now = lists.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    ends = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return now.join(ends, "key", "left_semi").select(F.col("id").alias("doc_id")).distinct()


def _links_by_full_sets(docs: DataFrame, open_ids: DataFrame, classes: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    """All ``links`` and those among ``open_ids`` (doc_id), which meet again in the lists of their full sets.

    A sketch allows for its error and lists nearly half of its values, a full set a quarter at most, and
    there a member leaves the lists in which nobody's size can reach the threshold with it. Most members of
    a group that lie too far from each other part here, so blocks compare only what is left."""
    named = classes.select(F.col("id").alias("doc_id"), "print")
    sets = written(full_sets(docs, open_ids).join(named, ["doc_id", "print"], "left_semi").dropDuplicates(["doc_id", "print"]))
    lists = written(full_postings(sets))
    least = lists.groupBy("key").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    lists = lists.join(least, "key").where("most >= least").drop("least", "_rows")
    lists = written(_with_length(lists))
    long = lists.where(F.col("len") > SHORT_LIST)
    stars = _stars(long, long, (-F.col("most")).alias("central"))
    pairs = _apart(_pairs_of_short(lists.where(F.col("len") <= SHORT_LIST)).union(stars).distinct(), found)
    links = written(links.union(_confirmed(docs, _estimated(pairs, classes), sets)))
    used = written(_blocks(long.drop("most"), classes, components(links)))
    return links.union(_linked_in_blocks(used, sets)) if used.limit(1).count() else links


def _blocks(lists: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Members of long lists, in blocks of BLOCK by BLOCK (key, i, j), that have a candidate in another
    component by their sketches. Lists whose members are all linked by now are left out, and of the
    others' largest component only the pairs with members outside it are compared. A pair is looked
    at in the least of the lists that it shares alone."""
    now = lists.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = now.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    open_ = (sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.max("size").alias("n_main"), F.sum("size").alias("len"))
             .where("len > n_main").select("key", "main", F.ceil((F.col("len") - F.col("n_main")) / BLOCK).cast("int").alias("outer"), F.ceil(F.col("n_main") / BLOCK).cast("int").alias("inner")))
    rows = written(now.drop("len").join(open_, "key"))
    of = rows.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("lists")).join(classes.select("id", "sketch"), "id")
    # blocks from 0 hold the members outside the largest component, blocks from ``outer`` its own
    inside = F.col("component") == F.col("main")
    place = F.xxhash64("id")
    rows = rows.withColumn("block", F.when(inside, F.col("outer") + F.pmod(place, F.col("inner"))).otherwise(F.pmod(place, F.col("outer"))).cast("int"))
    others = F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner"))
    rows = (rows.withColumn("other", F.explode(F.sequence(F.lit(0), (others - 1).cast("int"))))
            .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "n")
            .join(of, "id"))
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes if c != "sketch")
    return rows.groupBy("key", "i", "j").applyInPandas(_used, schema)


def _linked_in_blocks(used: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among the members ``used`` of each block, which get their full sets.

    A block gives links only, one fewer than the members it joins at most: how many pairs it has to
    look at never becomes rows."""
    sets = sets.groupBy(F.col("doc_id").alias("_id")).agg(F.first("shingles").alias("shingles"))
    return used.join(sets, F.col("id") == F.col("_id")).drop("_id").groupBy("key", "i", "j").applyInPandas(_link, "a long, b long")


def _candidates(rows: pd.DataFrame, sketch: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of one block whose union sketch does not rule them out, and estimates.

    Pairs of one component, and pairs that share a lesser list than this one, are left out."""
    size = np.array([len(x) for x in sketch])
    value = np.concatenate(sketch)
    row = np.repeat(np.arange(len(rows)), size)
    _, code, count = np.unique(value, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    shared = count[code] > 1
    n, block, own = rows["n"].to_numpy(), rows["block"].to_numpy(), rows["key"].iloc[0]
    group, ids = rows["component"].to_numpy(), rows["id"].to_numpy()
    overlap = np.zeros((len(rows), len(rows)), np.float32)
    for lo in range(0, int(column[-1]) + 1, 4096):
        here = shared & (column[code] >= lo) & (column[code] < lo + 4096)
        held = np.zeros((len(rows), 4096), np.float32)
        held[row[here], column[code[here]] - lo] = 1
        overlap += held @ held.T
    # what the sketch of a union shares lies in both sketches, so a lower overlap rules a pair out
    pick = (overlap >= LEAST_ESTIMATE * np.maximum.outer(size, size)) & (group[:, None] != group[None, :]) & (ids[:, None] < ids[None, :])
    pick &= 100 * np.minimum.outer(n, n) >= PERCENT * np.maximum.outer(n, n)
    if rows["i"].iloc[0] != rows["j"].iloc[0]:
        pick &= block[:, None] != block[None, :]
    a, b = np.nonzero(pick)
    lists, estimate = rows["lists"].to_numpy(), np.zeros(len(a))
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if np.intersect1d(lists[x], lists[y], assume_unique=True)[0] == own:
            both = np.intersect1d(sketch[x], sketch[y], assume_unique=True)
            union = np.union1d(sketch[x], sketch[y])[:BOTTOM]
            estimate[k] = np.searchsorted(both, union[-1], side="right") / len(union)
    kept = estimate >= LEAST_ESTIMATE
    return a[kept], b[kept], estimate[kept]


def _used(rows: pd.DataFrame) -> pd.DataFrame:
    """The members of one block that have a candidate in it."""
    a, b, _ = _candidates(rows, list(rows["sketch"]))
    return rows.iloc[np.unique(np.concatenate([a, b]))].drop(columns="sketch")


def _link(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of one block, likely pairs first; a pair that is joined by then is not looked at."""
    sets = list(rows["shingles"])
    a, b, estimate = _candidates(rows, [x[:BOTTOM] for x in sets])
    ids, root, out = rows["id"].to_numpy(), {}, []

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    group = rows["component"].to_numpy().tolist()
    for k in np.argsort(-estimate, kind="stable").tolist():
        x, y = int(a[k]), int(b[k])
        p, q = find(group[x]), find(group[y])
        if p != q:
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= PERCENT * (len(sets[x]) + len(sets[y]) - both):
                root[p] = q
                out.append((ids[x], ids[y]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Sets that are equal (128 bits and size) are one class, represented by its smallest id. Classes
    meet in the lists of their rarest retained values. Of short lists all pairs are taken. Members of
    long lists, which hold many copies of one text, link to a centre first; whatever of a long list
    still lies apart after that meets again in lists of full sets, and what lies apart even there is
    compared block by block.

    Rows without words, and rows with a null id, link with nothing and are kept; their component is
    their own id. Rows that repeat an id count as one document. Texts of fewer than five words
    are one shingle. Other columns are ignored, and an empty table gives an empty result.
    """
    rows = checkpointed(prints(docs))
    named = rows.where("n_shingles > 0 and doc_id is not null")
    classes = representatives(docs, named)
    member = named.select("doc_id", "n_shingles", "print").join(
        classes.select(F.col("n").alias("n_shingles"), "print", "id"), ["n_shingles", "print"])
    own = member.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")

    met = written(_with_length(postings(classes)))
    hot_lists = met.where(F.col("len") > SHORT_LIST)
    # what is linked already needs no pair, so the work goes from few likely pairs to all the rest:
    # each member of long lists with the centre of its longest, all pairs and centres, lists of full sets
    longest = hot_lists.groupBy("id", "n").agg(F.max_by("key", F.struct("len", "key")).alias("key"))
    links = written(_confirmed(docs, _estimated(_stars(hot_lists, longest), classes)))
    pairs = _pairs_of_short(met.where(F.col("len") <= SHORT_LIST)).union(_stars(hot_lists, hot_lists)).distinct()
    links = written(links.union(_confirmed(docs, _estimated(_apart(pairs, components(links)), classes))))
    found = components(links)
    open_ids = written(_still_open(hot_lists, found))
    if open_ids.limit(1).count():
        links = written(_links_by_full_sets(docs, open_ids, classes, links, found))
    whole = components(links.union(own))
    return (rows.join(whole, F.col("doc_id") == F.col("id"), "left")
            .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
            .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their group, all columns unchanged.

    Rows without words and rows with a null id are kept. Of rows that repeat an id and its text one
    is kept; rows of one id with other texts are one document and are kept or go together. An empty
    table gives an empty result."""
    found = checkpointed(near_duplicates(docs).select("doc_id", "kept").where("doc_id is not null"))
    of = lambda ids: ids.select(F.col("doc_id").alias("_kept_id"))
    same = docs["doc_id"].cast("long") == F.col("_kept_id")
    left = docs.join(of(found.where(~F.col("kept")).select("doc_id").distinct()), same, "left_anti")
    repeated = found.groupBy("doc_id").count().where("count > 1")
    return left.join(of(repeated), same, "left_anti").unionByName(left.join(of(repeated), same, "left_semi").dropDuplicates(["doc_id", "text"]))
