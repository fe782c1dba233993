"""Embedding near-duplicates by an inverted multi-index (operator 8).

Two codebooks, learnt independently on the halves of unit vectors, form a grid of cells; a vector
lies in the cell of its nearest codewords. Each vector visits cells in the order of their distance
(the multi-sequence order) and is compared in double precision with the vectors that lie there.
How many cells it visits follows from a target recall for neighbours at the threshold itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hash_share, shipped, written
from .components import components

THRESHOLD = 0.93
#: Vectors that the codebooks and the number of visits are fitted on, at most.
SAMPLE = 8192
#: Share of neighbours at the threshold that one side's visits must find.
TARGET_RECALL = 0.995
#: Vectors of a label that a cell should hold, and the most codewords of a half.
PER_CELL, MOST_WORDS = 64, 256
#: Members and visitors of a cell that are compared in one task call.
MEMBERS, VISITORS = 1024, 4096


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None, :], 0)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means; an empty cluster keeps its word."""
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(15):
        near = _distances(x, words).argmin(axis=1)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(words))[:, None]
        words = np.where(n > 0, sums / np.maximum(n, 1), words)
    return words


@dataclass
class MultiIndex:
    """Codebooks of the two halves of vectors of one length, and the cells to visit."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def order(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The nearest cells of each vector, nearest first; column 0 is its own cell."""
        half = self.first.shape[1]
        a, b = _distances(x[:, :half], self.first), _distances(x[:, half:], self.second)
        wide = [min(visits, d.shape[1]) for d in (a, b)]
        near = [np.argsort(d, axis=1, kind="stable")[:, :w] for d, w in zip((a, b), wide, strict=True)]
        da, db = np.take_along_axis(a, near[0], 1), np.take_along_axis(b, near[1], 1)
        # the n-th cell in the order has (rank + 1) * (rank + 1) of its words at most n
        i, j = np.nonzero(np.outer(np.arange(1, wide[0] + 1), np.arange(1, wide[1] + 1)) <= visits)
        best = np.argsort(da[:, i] + db[:, j], axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(near[0][:, i] * len(self.second) + near[1][:, j], best, 1)

    def cells(self) -> int:
        return len(self.first) * len(self.second)


def fit(sample: np.ndarray, words: int, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> MultiIndex:
    """Codebooks of ``words`` words, and visits enough for the target on drawn neighbours.

    For each sampled vector a neighbour is drawn at the threshold in a random direction; the visits
    are the ``target`` quantile of the place of its cell in the vector's order. Closer neighbours,
    and pairs that either side can find, do better.
    """
    rng = np.random.default_rng(7)
    half = sample.shape[1] // 2
    index = MultiIndex(_codebook(sample[:, :half], words, rng), _codebook(sample[:, half:], words, rng), 1)
    if sample.shape[1] > 1 and index.cells() > 1:
        x = sample[:2048]
        away = rng.standard_normal(x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        y = threshold * x + np.sqrt(1 - threshold**2) * unit(away)
        place = (index.order(x, index.cells()) == index.order(y, 1)).argmax(axis=1)
        index.visits = int(np.quantile(place, target, method="higher")) + 1
    return index


def usable(embedding: Column) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) > 0) & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def links(classes: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """id, n (links found, copies counted), root (a linked id) from each block of compared cells.

    ``classes`` has id, label, embedding (usable, distinct within a label) and copies.
    """
    sizes = classes.groupBy(F.size("embedding").alias("dim"), "label").agg(F.count(F.lit(1)).alias("n"))
    of = {r["dim"]: r for r in sizes.groupBy("dim").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}
    rate = min(1.0, sample / max(1, sum(r["n"] for r in of.values())))
    drawn = (classes.where(hash_share(F.lit("index"), "id") < 1.5 * rate).select("embedding", F.xxhash64("id").alias("h"))
             .orderBy("h").limit(sample).toPandas()["embedding"])
    indexes = {}
    for dim, r in of.items():
        x = np.array([v for v in drawn if len(v) == dim], float).reshape(-1, dim)
        words = min(MOST_WORDS, max(1, round((r["most"] / PER_CELL) ** 0.5)))
        indexes[dim] = fit(unit(x) if len(x) else np.ones((1, dim)), words, threshold)
    shared = {dim: shipped(classes.sparkSession, index) for dim, index in indexes.items()}

    def place(batches):
        for rows in batches:
            dims = rows["embedding"].str.len()
            for dim, part in rows.groupby(dims):
                x, index = unit(np.array(part["embedding"].tolist(), float)), shared[dim]()
                cells = np.concatenate([index.order(x[k : k + 512], index.visits) for k in range(0, len(x), 512)])
                yield part.assign(dim=dim, cells=list(cells.astype(np.int32)), embedding=list(x))

    vectors = checkpointed(classes.mapInPandas(place, "id long, label string, embedding array<double>, copies long, dim int, cells array<int>")
                           .withColumn("cell", F.col("cells")[0]))
    at = ["label", "dim", "cell"]
    visitors = vectors.withColumn("home", F.col("cell")).withColumn("cell", F.explode("cells"))
    members = vectors.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("m_blocks"))
    blocks = members.join(visitors.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("v_blocks")), at)
    pick = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    again = vectors.select(*[F.col(c).alias(c) for c in vectors.columns])  # a side of its own for the cogroup
    members = (again.join(blocks, at).withColumn("m", pick("m_blocks")).withColumn("v", every("v_blocks"))
               .select(*at, "m", "v", "id", "embedding", "copies", "cells"))
    visitors = (visitors.join(blocks, at).withColumn("v", pick("v_blocks")).withColumn("m", every("m_blocks"))
                .select(*at, "m", "v", "id", "embedding", "copies", "home"))
    key = [*at, "m", "v"]
    return visitors.groupBy(*key).cogroup(members.groupBy(*key)).applyInPandas(_comparer(threshold), "id long, n long, root long")


def _comparer(threshold: float):
    def run(visitors: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if visitors.empty or members.empty:
            return pd.DataFrame({"id": [], "n": [], "root": []}, dtype="int64")
        a, b = visitors["id"].to_numpy(), members["id"].to_numpy()
        y = np.array(members["embedding"].tolist())
        cells = np.array(members["cells"].tolist())
        va, vb = [], []
        for k in range(0, len(a), 512):
            x = np.array(visitors["embedding"].iloc[k : k + 512].tolist())
            i, j = np.nonzero(x @ y.T >= threshold)
            va.append(i + k)
            vb.append(j)
        i, j = np.concatenate(va), np.concatenate(vb)
        other = a[i] != b[j]
        i, j = i[other], j[other]
        # the visitor counts what it finds; a member that does not visit back is counted here too
        home = visitors["home"].to_numpy()
        back = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            back[k : k + (1 << 16)] = (cells[j[k : k + (1 << 16)]] == home[i[k : k + (1 << 16)], None]).any(axis=1)
        n_a = np.bincount(i, members["copies"].to_numpy()[j], len(a))
        n_b = np.bincount(j[~back], visitors["copies"].to_numpy()[i[~back]], len(b))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n_a, n_b]), len(ids)).astype(np.int64)
        root = np.arange(len(ids))
        p, q = at[i], at[len(a) + j]
        while True:  # the smallest id that each is linked to within the block
            was = root.copy()
            low = np.minimum(root[p], root[q])
            np.minimum.at(root, p, low)
            np.minimum.at(root, q, low)
            root = root[root]
            if (root == was).all():
                break
        some = n > 0
        some |= root != np.arange(len(ids))
        some[root[some]] = True
        return pd.DataFrame({"id": ids[some], "n": n[some], "root": ids[root[some]]})

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings`` (vec_id, embedding, label).

    Only vectors of one label and one length are compared. A null label, and a vector that is null,
    empty, zero or holds a null or non-finite component, links with nothing. Equal vectors of a
    label are one class with copies, so groups of copies cost one comparison; the copies link with
    each other. A row that repeats an id is a vector of its own, its component the smallest id of
    the group; a null id alone has a null component and is kept. Other columns are ignored and an
    empty table gives an empty result. All rows are indexed; only the codebooks see a sample.
    """
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), "embedding")
    usable_ = usable(F.col("embedding")) & F.col("label").isNotNull()
    prints = [F.when(usable_, F.xxhash64(F.lit(k), F.col("embedding"))).alias(f"print{k}") for k in (1, 2)]
    named = checkpointed(rows.select("vec_id", "label", "embedding", *prints, F.monotonically_increasing_id().alias("rid")))
    same = ["label", "print1", "print2"]
    classes = checkpointed(named.where("print1 is not null").groupBy(*same).agg(
        F.min("rid").alias("id"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies")))
    found = written(links(classes.select("id", "label", "embedding", "copies"), threshold))
    group = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "_member")
    counts = found.groupBy(F.col("id").alias("_counted")).agg(F.sum("n").alias("n"))
    classes = (classes.drop("embedding").join(group, F.col("id") == F.col("_member"), "left").join(counts, F.col("id") == F.col("_counted"), "left")
               .select(*same, F.coalesce("component", "id").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    wide = named.drop("embedding").join(classes, same, "left").withColumn("root", F.coalesce("root", "rid"))
    least = wide.groupBy(F.col("root").alias("_root")).agg(F.min("vec_id").alias("component_id"))
    return (wide.join(least, F.col("root") == F.col("_root"))
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id",
                    F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")))
