"""Conversation prefix trie by composable fingerprints (operator 12).

A rebuilt conversation is the head of its family's base conversation and its own suffix. The
fingerprint of a sequence of turns is the sum of t_j * R**j modulo 2**64 with odd R, for two R;
of two sequences joined it is S1 + S2 * R**n1, a monoid whose elements have inverses. So each
prefix of a rebuilt conversation follows from the base's head and the conversation's own sums, and
no rebuilt text is ever made: a rebuilt turn is a reference to a stored one. Conversations with
equal fingerprints of a depth are one node; that their last turns and their parents are equal too
is verified for every node, from the references, and by induction their whole prefixes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .common import WORD, checkpointed, shipped, written

#: Conversations of a family, and heads: a head has crc32 of the id modulo HEADS turns.
FAMILY, HEADS = 20, 4
#: Turns of a sorted partition, about, and depths that share a chunk of a running sum.
PART_ROWS, CHUNK = 100_000, 4096
#: Odd numbers, one pair for each try; the next is taken if two unequal prefixes share a fingerprint.
BASES = ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xC2B2AE3D27D4EB4F, 0x27BB2EE687B0B0FD), (0x165667B19E3779F9, 0xA0761D6478BD642F))
NODE = ["depth", "f1", "f2"]

TURN = "base long, own int, conv_id long, k1 long, k2 long, words long"
REBUILT = "conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, source long, place long, k1 long, k2 long, words long, ends boolean"


def stored_turns(conversations: DataFrame) -> DataFrame:
    """base, own, conv_id, turn, k1, k2 (128 bits of a SHA-256 of role and text), words of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    key = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    conv = F.col("conv_id").try_cast("long")
    base = conv - conv % FAMILY
    return (conversations.where(conv.isNotNull())
            .select(base.alias("base"), (conv != base).cast("int").alias("own"), conv.alias("conv_id"), "turn", key(1).alias("k1"), key(17).alias("k2"),
                    F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")))


def _terms(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = k1.view(np.uint64), k2.view(np.uint64)
    return ts.mix(a ^ ts.mix(b)), ts.mix(b + ts.mix(~a))


def _power(r: int, n: np.ndarray) -> np.ndarray:
    """r ** n modulo 2**64 of each n >= 0."""
    out, n, r = np.ones(len(n), np.uint64), n.copy(), r
    while n.any():
        out[n & 1 == 1] *= np.uint64(r)
        n >>= 1
        r = r * r % (1 << 64)
    return out


def _sum(head: list[tuple[int, int, int]], lane: int, r: int) -> int:
    """The fingerprint of a few turns (k1, k2, words)."""
    if not head:
        return 0
    terms = _terms(*(np.array([t[k] for t in head], np.int64) for k in (0, 1)))[lane]
    return sum(int(t) * pow(r, j, 1 << 64) for j, t in enumerate(terms)) % (1 << 64)


def _columns(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """The columns of a whole partition, whose size is bounded by the range partitioning."""
    names, parts = [x.split()[0] for x in TURN.split(", ")], list(batches)
    return {c: np.concatenate([np.zeros(0, np.int64), *[b.column(k).to_numpy() for b in parts]]) for k, c in enumerate(names)}


def _segments(conv: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values."""
    cut = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1], [True]])) if len(conv) else np.zeros(1, np.int64)
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def _head(t: dict[str, np.ndarray], lo: int, hi: int) -> list[tuple[int, int, int]]:
    hi = min(hi, lo + HEADS - 1)
    return list(zip(*(t[c][lo:hi].tolist() for c in ("k1", "k2", "words")), strict=True))


def _summaries(sorted_turns: DataFrame, bases: tuple[int, int]) -> list:
    """Of each partition its first and last run of a conversation, and the last family's base if it
    lies there: at most three rows, all that reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = _columns(batches)
        runs = _segments(t["conv_id"])
        if not runs:
            return
        family = [k for k, (lo, _) in enumerate(runs) if t["base"][lo] == t["base"][-1]][0]
        rows = []
        for k in sorted({0, family if t["own"][runs[family][0]] == 0 else 0, len(runs) - 1}):
            lo, hi = runs[k]
            terms = _terms(t["k1"][lo:hi], t["k2"][lo:hi])
            sums = [int((x * _power(r, np.arange(hi - lo))).sum(dtype=np.uint64).view(np.int64)) for x, r in zip(terms, bases, strict=True)]
            rows.append((TaskContext.get().partitionId(), k, int(t["base"][lo]), int(t["conv_id"][lo]), hi - lo, *sums, [list(x) for x in _head(t, lo, hi)]))
        names = ["pid", "k", "base", "conv_id", "n", "s1", "s2", "head"]
        yield pa.RecordBatch.from_arrays([pa.array(x) if c != "head" else pa.array(x, pa.list_(pa.list_(pa.int64()))) for c, x in zip(names, zip(*rows, strict=True), strict=True)], names)

    schema = "pid long, k long, base long, conv_id long, n long, s1 long, s2 long, head array<array<long>>"
    return sorted(sorted_turns.mapInArrow(run, schema).collect(), key=lambda r: (r.pid, r.k))


def _carries(summaries: list, bases: tuple[int, int]) -> dict[int, tuple]:
    """What each partition takes from those before it, folded in the monoid: the family's base head,
    the open conversation with its turns so far, their sums and head; and the sizes of the
    conversations that cross its borders."""
    size: dict[int, int] = {}
    for r in summaries:
        size[r.conv_id] = size.get(r.conv_id, 0) + r.n
    out, last = {}, {}
    for r in summaries:
        last[r.pid] = r.conv_id
    family = conv = None
    base_head, head, n, sums = [], [], 0, [0, 0]
    for r in summaries:
        if r.pid not in out:
            out[r.pid] = (family, list(base_head), conv, n, tuple(sums), list(head), {c: size[c] for c in (r.conv_id, last[r.pid])})
        if r.base != family:
            family, base_head = r.base, []
        if r.conv_id != conv:
            conv, head, n, sums = r.conv_id, [], 0, [0, 0]
        sums = [(s + (x % (1 << 64)) * pow(b, n, 1 << 64)) % (1 << 64) for s, x, b in zip(sums, (r.s1, r.s2), bases, strict=True)]
        n += r.n
        head = (head + [tuple(x) for x in r.head])[: HEADS - 1]
        if conv == family:
            base_head = head
    return out


def _rebuild(t: dict[str, np.ndarray], carry: tuple, bases: tuple[int, int]) -> dict[str, np.ndarray]:
    """The rebuilt rows that the turns of one partition give."""
    import zlib

    family, base_head, conv, n_before, s_before, head, size = carry
    runs = _segments(t["conv_id"])
    n = len(t["conv_id"])
    first = np.zeros(n, np.int64)
    for lo, hi in runs:
        first[lo:hi] = lo
    place = np.arange(n) - first
    open_ = runs[0][1] if t["conv_id"][0] == conv else 0
    place[:open_] += n_before
    sums = []
    for lane, r in enumerate(bases):
        total = np.cumsum(_terms(t["k1"], t["k2"])[lane] * _power(r, place), dtype=np.uint64)
        total -= np.concatenate([[np.uint64(0)], total])[first]
        total[:open_] += np.uint64(s_before[lane])
        sums.append(total)
    # of each row: turns of the head (k) and of the stored turns that it replaces (h), and the sums of both
    k_, h_ = np.zeros(n, np.int64), np.zeros(n, np.int64)
    of_head, of_own = (np.zeros((2, n), np.uint64) for _ in range(2))
    extra: list[tuple] = []  # depth 0 and head rows of conversations that begin here
    total_of = np.zeros(n, np.int64)
    for x, (lo, hi) in enumerate(runs):
        c, b = int(t["conv_id"][lo]), int(t["base"][lo])
        if b != family:
            family, base_head = b, []
        begins = lo >= open_
        here = _head(t, lo, hi)
        own_head = here if begins else (head + here)[: HEADS - 1]
        if c == b:
            base_head, h = own_head, 0
        else:
            h = zlib.crc32(str(c).encode()) % HEADS
        k = min(h, len(base_head))
        total_of[lo:hi] = size.get(c, hi - lo) if x in (0, len(runs) - 1) else hi - lo
        k_[lo:hi], h_[lo:hi] = k, h
        for lane, r in enumerate(bases):
            of_head[lane, lo:hi] = _sum(base_head[:k], lane, r) if k else 0
            of_own[lane, lo:hi] = _sum(own_head[:h], lane, r) if h else 0
        if begins:
            short = int(total_of[lo]) <= h
            extra.append((c, 0, 0, 0, None, None, None, None, 0, 0, 0, short and k == 0))
            for d in range(1, k + 1):
                f, p = ([_sum(base_head[:e], lane, r) for lane, r in enumerate(bases)] for e in (d, d - 1))
                extra.append((c, d, *f, *p, b, d - 1, *base_head[d - 1], short and d == k))
    keep = np.flatnonzero(place >= h_)
    out = {"conv_id": t["conv_id"][keep], "depth": (k_ + place - h_ + 1)[keep]}
    after = {}
    for lane, (r, name) in enumerate(zip(bases, "12", strict=True)):
        # the own sum without its first h turns, moved to begin after k: R ** (k - h), k <= h
        move = _power(pow(r, -1, 1 << 64), (h_ - k_)[keep])
        s = sums[lane][keep]
        last = s - _terms(t["k1"][keep], t["k2"][keep])[lane] * _power(r, place[keep])
        for f, x in (("f", s), ("p", last)):
            after[f + name] = (of_head[lane, keep] + (x - of_own[lane, keep]) * move).view(np.int64)
    out |= {c: after[c] for c in ("f1", "f2", "p1", "p2")}
    out |= {"source": t["conv_id"][keep], "place": place[keep], "k1": t["k1"][keep], "k2": t["k2"][keep], "words": t["words"][keep],
            "ends": place[keep] == total_of[keep] - 1}
    signed = lambda x: None if x is None else x - (1 << 64) if x >= 1 << 63 else x
    more = list(zip(*extra, strict=True)) if extra else [()] * len(out)
    arrays = {}
    for (c, x), y in zip(out.items(), more, strict=True):
        kind = pa.bool_() if c == "ends" else pa.int64()
        arrays[c] = pa.concat_arrays([pa.array([signed(v) for v in y] if c[0] in "fp" and c != "place" else list(y), kind), pa.array(x, kind)])
    return arrays


def rebuilt(conversations: DataFrame, bases: tuple[int, int] = BASES[0]) -> DataFrame:
    """A row for each depth of each rebuilt conversation, from 0: conv_id, depth, f1, f2 (fingerprint
    of the prefix), p1, p2 (of the parent), source and place (the stored turn that stands there),
    k1, k2 (its content), words, ends (the conversation has no more turns).

    Turns are range-partitioned by family and order and checkpointed, so that a conversation of any
    length spreads over tasks; a partition takes at most three summaries of those before it.
    """
    turns = stored_turns(conversations)
    spark = turns.sparkSession
    order = ["base", "own", "conv_id", "turn", "k1", "k2"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // PART_ROWS))
    # equal rows may be many; any number tells them apart, since their order does not matter
    spread = turns.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "_any").sortWithinPartitions(*order)
    sorted_ = checkpointed(spread.select(*[x.split()[0] for x in TURN.split(", ")]))
    carries = shipped(spark, _carries(_summaries(sorted_, bases), bases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = _columns(batches)
        if len(t["conv_id"]):
            yield pa.RecordBatch.from_pydict(_rebuild(t, carries()[TaskContext.get().partitionId()], bases))

    return written(sorted_.mapInArrow(run, REBUILT))


def _end_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ascending comma-joined conv_ids that end at each node.

    Ids are range-partitioned, so a node's ids are joined to texts of a batch in many tasks; what
    hashes a node then streams over those texts and holds one of them.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(4)]
            new = np.zeros(len(b), bool)
            new[:1] = True
            for c in cols[:3]:
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            ids = list(map(str, cols[3].tolist()))
            texts = [",".join(ids[lo:hi]) for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(b)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[at]) for c in cols], pa.array(texts)], [*NODE, "first", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for b in batches:
            for *node, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if node != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = node, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], [*NODE, "ends_sha256"])
                done = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], [*NODE, "ends_sha256"])

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = rows.where("ends").select(*NODE, "conv_id").repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    texts = ends.mapInArrow(joined, "depth long, f1 long, f2 long, first long, text string")
    texts = texts.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return texts.mapInArrow(hashed, "depth long, f1 long, f2 long, ends_sha256 string")


def _running(nodes: DataFrame) -> DataFrame:
    """NODE and ``above``: what the shared nodes of the same smallest member save above each of them,
    summed by chunks of depths, so that a long path is no single window."""
    shared = nodes.where("n_convs > 1").select(*NODE, "conv_id", "saves", F.expr(f"depth div {CHUNK}").alias("chunk"))
    before = lambda w: F.coalesce(F.sum("saves").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = shared.groupBy("conv_id", "chunk").agg(F.sum("saves").alias("saves"))
    chunks = chunks.select("conv_id", "chunk", before(Window.partitionBy("conv_id").orderBy("chunk")).alias("earlier"))
    within = shared.withColumn("within", before(Window.partitionBy("conv_id", "chunk").orderBy("depth")))
    return within.join(chunks, ["conv_id", "chunk"]).select(*NODE, (F.col("within") + F.col("earlier")).alias("above"))


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations.

    Per node: conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256; and f1, f2 (its fingerprint), source, place (a stored turn
    equal to its last; root: null). Rows with a null conv_id (or one that is no integer) take no
    part. Turns are ordered by turn, null first, and those of one turn by content; a repeated row is
    a turn again. Other columns are ignored. An empty table has no node, not even a root.
    """
    for bases in BASES:
        rows = rebuilt(conversations, bases)
        same = [F.min(c).eqNullSafe(F.max(c)) for c in ("k1", "k2", "p1", "p2")]
        nodes = written(rows.groupBy(*NODE).agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("words").alias("words"),
            F.min(F.struct("source", "place")).alias("turn"), (same[0] & same[1] & same[2] & same[3]).alias("equal")))
        if not nodes.where(~F.col("equal")).limit(1).count():
            break
    else:
        raise RuntimeError("unequal prefixes share a fingerprint with every base")
    nodes = nodes.withColumn("saves", (F.col("n_convs") - 1) * F.col("words"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count(F.lit(1)).alias("n_children"))
    # a childless node is a leaf of its smallest member, and what a node saves is its smallest member's
    leaf = nodes.select(*NODE, "conv_id", "saves").join(children, NODE, "left")
    of = leaf.groupBy(F.col("conv_id").alias("_conv")).agg(F.sum("saves").alias("saved"), F.max(F.col("n_children").isNull().cast("long")).alias("leaf"))
    sums = rows.select(*NODE, "conv_id").join(of, F.col("conv_id") == F.col("_conv")).groupBy(*NODE).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("n_leaves"))
    named = {"n_children": "long", "saved": "long", "n_leaves": "long", "above": "long", "ends_sha256": "string"}
    parts = [x.select(*NODE, *[F.col(c) if c in x.columns else F.lit(None).cast(kind).alias(c) for c, kind in named.items()])
             for x in (children, sums, _running(nodes), _end_digests(rows))]
    found = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).groupBy(*NODE).agg(*[F.max(c).alias(c) for c in named])
    parent = nodes.select((F.col("depth") + 1).alias("_depth"), F.col("f1").alias("_p1"), F.col("f2").alias("_p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(found, NODE).join(parent, (F.col("depth") == F.col("_depth")) & (F.col("p1") == F.col("_p1")) & (F.col("p2") == F.col("_p2")), "left")
    none = hashlib.sha256(b"").hexdigest()
    saved = F.when(F.col("n_convs") > 1, F.col("saved") - F.col("above")).otherwise(F.lit(0))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
                        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "f1", "f2", "turn.source", "turn.place")
