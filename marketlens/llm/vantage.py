"""Approximate nearest neighbours by vantage-point trees (operator 11).

Vectors are dealt to shards, and each shard is a vantage-point tree: a node holds a vector, and the
ranges of distance from it of the vectors inside and outside its median sphere. A query skips a
child whose range lies farther from its own distance than its k-th nearest so far (the triangle
inequality). The gap is multiplied by a factor: one keeps the search exact, more skips more.

The largest inner product is the least distance once each vector x of a shard is lengthened by
sqrt(M**2 - |x|**2), M the greatest length in the shard, and a query by 0: then
distance**2 = |q|**2 + M**2 - 2 q.x.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 20
#: Vectors of a shard and queries of a block, about.
SHARD_ROWS, BLOCK_ROWS = 8192, 2048
#: Vectors of a leaf.
LEAF_ROWS = 128
#: Gaps are multiplied by this before they are compared with the distance to the k-th nearest.
FACTOR = 2.0
#: Blocks of queries that meet one copy of a shard.
BLOCKS_TOGETHER = 16


def usable(embedding: Column) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) > 0) & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


@dataclass
class Tree:
    """The vantage-point tree of one shard.

    ``nodes`` are (vantage vector, least and greatest distance inside and outside, inner child,
    outer child); a leaf is (lo, hi), its rows. Children are numbers of ``nodes``, the root is 0.
    """

    x: np.ndarray
    rows: np.ndarray
    longest: float = 0.0
    nodes: list = field(default_factory=list)

    @classmethod
    def build(cls, x: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
        tree = cls(x, rows)
        length = (x * x).sum(axis=1)
        tree.longest = float(length.max())
        tall = np.concatenate([x, np.sqrt(np.maximum(tree.longest - length, 0))[:, None]], axis=1)
        order = np.arange(len(x))

        def grow(lo: int, hi: int) -> int:
            at = len(tree.nodes)
            tree.nodes.append((lo, hi))
            if hi - lo <= leaf:
                return at
            part = order[lo:hi]
            # the vantage is the member farthest from the first one, so spheres cut a cluster's edge
            first = ((tall[part] - tall[part[0]]) ** 2).sum(axis=1)
            vantage = tall[part[first.argmax()]].copy()
            d = np.sqrt(((tall[part] - vantage) ** 2).sum(axis=1))
            by = np.argsort(d, kind="stable")
            order[lo:hi], d = part[by], d[by]
            half = (hi - lo) // 2
            inner, outer = grow(lo, lo + half), grow(lo + half, hi)
            tree.nodes[at] = (vantage, (d[0], d[half - 1]), (d[half], d[-1]), inner, outer)
            return at

        grow(0, len(x))
        tree.x, tree.rows = x[order], rows[order]
        return tree

    def search(self, q: np.ndarray, k: int, factor: float = FACTOR) -> tuple[list[np.ndarray], int]:
        """For each query the places of its k largest inner products found (and of any within
        rounding of them), and the number of products that were taken."""
        best = np.full((len(q), k), -np.inf)
        own = (q * q).sum(axis=1)
        # products that differ by rounding alone must not decide who is kept
        slack = 1e-9 * (np.sqrt(own * self.longest) + 1e-300)
        found: list[list] = [[] for _ in q]
        taken = 0

        def reach(some: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(own[some] + self.longest - 2 * (best[some, 0] - slack[some]), 0))

        def visit(at: int, some: np.ndarray) -> None:
            nonlocal taken
            node = self.nodes[at]
            if len(node) == 2:
                lo, hi = node
                scores = q[some] @ self.x[lo:hi].T
                taken += scores.size
                keep = scores >= (best[some, 0] - slack[some])[:, None]
                for i, s, row in zip(some.tolist(), scores, keep, strict=True):
                    at_ = np.flatnonzero(row)
                    if len(at_):
                        found[i].append((at_ + lo, s[at_]))
                merged = np.concatenate([best[some], scores], axis=1)
                best[some] = np.sort(np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:], axis=1)
                return
            vantage, inside, outside, inner, outer = node
            d = np.sqrt(np.maximum(own[some] + vantage @ vantage - 2 * (q[some] @ vantage[:-1]), 0))
            gaps = [np.maximum(np.maximum(d - high, low - d), 0) for low, high in (inside, outside)]
            nearer = gaps[0] <= gaps[1]
            for inner_first in (True, False):
                mine = nearer == inner_first
                if not mine.any():
                    continue
                group = some[mine]
                for child, gap in ((inner, gaps[0]), (outer, gaps[1])) if inner_first else ((outer, gaps[1]), (inner, gaps[0])):
                    go = group[factor * gap[mine] <= reach(group)]
                    if len(go):
                        visit(child, go)

        visit(0, np.arange(len(q)))
        out = []
        for i, parts in enumerate(found):
            at = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            score = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
            out.append(at[score >= best[i, 0] - slack[i]])
        return out, taken


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query, summed in one order, so that equal vectors have equal scores."""
    return (x * q).sum(axis=1)


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id, print, embedding (array<double>, -0.0 as 0.0) of the rows that take part."""
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = embeddings.where(usable(F.col("embedding"))).select(F.col("vec_id").try_cast("long").alias("vec_id"), vector.alias("embedding"))
    return rows.where("vec_id is not null").select("vec_id", F.xxhash64("embedding").alias("print"), "embedding")


def classes(embeddings: DataFrame, k: int) -> DataFrame:
    """print, dim, embedding and the k + 1 smallest vec_ids of each distinct vector that takes part.

    A copy can only be among k results by one of its k + 1 smallest ids (the query's own may be one),
    so groups of copies of any size cost one comparison."""
    rows = valid(embeddings).withColumn("print2", F.xxhash64(F.lit(2), "embedding"))
    same = ["print", "print2"]
    ranked = rows.select(*same, "vec_id").distinct().withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy("vec_id")))
    ids = ranked.where(F.col("place") <= k + 1).groupBy(*same).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    one = rows.groupBy(*same).agg(F.first("embedding").alias("embedding"))
    return one.join(ids, same).select("print", F.size("embedding").alias("dim"), "embedding", "ids")


def _of_dim(numbers: dict[int, int]) -> Column:
    """The number of a row's vector length, null if there is none."""
    pairs = [F.lit(v).cast("int") for item in numbers.items() for v in item]
    return F.create_map(*pairs)[F.col("dim")] if pairs else F.lit(None).cast("int")


def index(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """dim, shard, tree (pickled ``Tree`` and the ids of its rows): every distinct vector is in one
    shard, dealt by its print, so that any split of the input gives the same shards."""
    sizes = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = _of_dim({dim: -(-n // shard_rows) for dim, n in sizes.items()})
    dealt = distinct.withColumn("shard", F.pmod(F.col("print"), shards).cast("int"))

    def build(key, t):
        t = t.sort_by("print")
        x = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        ids = t.column("ids").combine_chunks()
        tree = Tree.build(x, np.arange(t.num_rows))
        lists = ids.take(pa.array(tree.rows))
        data = pickle.dumps((tree.x, tree.longest, tree.nodes, lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([data], pa.binary())})

    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary")


def blocks(queries: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """dim, block, ids, prints and vectors (bytes) of the queries (vec_id, print, embedding), block by block."""
    sizes = {r["dim"]: r["n"] for r in queries.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = _of_dim({dim: -(-n // block_rows) for dim, n in sizes.items()})
    dealt = queries.withColumn("dim", F.size("embedding")).withColumn("block", F.pmod(F.xxhash64("vec_id", "print"), counts).cast("int"))

    def pack(key, t):
        x = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids, prints = (t.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "print"))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids], pa.binary()),
                         "prints": pa.array([prints], pa.binary()), "vectors": pa.array([x.astype("<f8").tobytes()], pa.binary())})

    return dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids binary, prints binary, vectors binary")


def search(trees: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, print, rank, vec_id, score: the k nearest found of each query (vec_id, print, embedding).

    Blocks of queries meet every shard of their length; a copy of a shard serves BLOCKS_TOGETHER
    blocks, which travel to it. Each shard gives at most k results a query, and a query's results are ranked with a
    limit before the shuffle."""
    spark = trees.sparkSession
    packed = written(blocks(queries, block_rows))
    per = lambda t, c: {r["dim"]: r["n"] for r in t.groupBy("dim").agg((F.max(c) + 1).alias("n")).collect()}
    shards, groups = per(trees, "shard"), {dim: -(-n // BLOCKS_TOGETHER) for dim, n in per(packed, "block").items()}
    key = ["dim", "shard", "together"]
    # a task for every few pairs of a shard and a group of blocks, however little data they are
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(n * groups.get(dim, 0) for dim, n in shards.items()) // 4)
    every = lambda counts: F.explode(F.sequence(F.lit(0), _of_dim(counts) - 1))
    copies = trees.where(_of_dim(groups).isNotNull()).withColumn("together", every(groups)).repartition(tasks, *key)
    asked = (packed.where(_of_dim(shards).isNotNull()).withColumn("together", F.expr(f"int(block div {BLOCKS_TOGETHER})")).withColumn("shard", every(shards))
             .repartition(tasks, *key))
    pairs = copies.join(asked, key).select("tree", "ids", "prints", "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, *packed_ in zip(*(b.column(c) for c in range(4)), strict=True):
                x, longest, nodes, offs, members = pickle.loads(data.as_buffer())
                of, prints, flat = (np.frombuffer(p.as_buffer(), kind) for p, kind in zip(packed_, ("<i8", "<i8", "<f8"), strict=True))
                q = flat.reshape(len(of), -1)
                # the query itself may be one of those found
                got, _ = Tree(x, np.arange(len(x)), longest, nodes).search(q, k + 1, factor)
                out = [[], [], [], []]
                for i, at in enumerate(got):
                    size = offs[at + 1] - offs[at]
                    near = members[np.repeat(offs[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    score = np.repeat(products(q[i], x[at]), size)
                    other = (near != of[i]) | np.repeat((x[at] != q[i]).any(axis=1), size)
                    near, score = near[other], score[other]
                    first = np.lexsort((near, -score))[:k]
                    for column, values in zip(out, (np.full(len(first), of[i]), np.full(len(first), prints[i]), near[first], score[first]), strict=True):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "print", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, print long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "print").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "print", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, is_query: Column, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (the inner product) of the k nearest found of each
    row of ``embeddings`` (vec_id, embedding) for which ``is_query`` holds, ties to the smaller vec_id.

    All rows are candidates but the query's own. Rows whose vector is null, empty, zero or holds a
    null or non-finite component, and rows with a null id, take no part; vectors of another length
    are no candidates. A row that repeats an id and its vector counts once; an id with several
    vectors is a candidate and a query with each of them. Other columns are ignored and an empty
    table gives an empty result. A ``factor`` of one makes the search exact.
    """
    distinct = written(classes(embeddings, k))
    trees = written(index(distinct, shard_rows))
    queries = valid(embeddings.where(is_query)).dropDuplicates(["vec_id", "print"])
    return search(trees, queries, k, factor, block_rows).drop("print")
