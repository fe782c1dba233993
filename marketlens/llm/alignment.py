"""Cross-tokenizer alignment (operator 13).

Two tokenizers cut the same bytes, a space and the text, into tokens. In a batch of documents the
tokens of both sides are rows keyed by document, and ``pandas.merge_asof`` finds for each token's
start the other side's token that covers it; both directions together are the overlapping pairs.
Offsets at which tokens of both sides end cut the tokens into groups, and all pairs of a group are
its links. A pair of ids counts the documents that hold it linked.
"""

from __future__ import annotations

import functools
import hashlib
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .common import give_back, shipped, written

#: Bytes of chunks of text whose ids a worker keeps, at most (and one slice more).
CACHED_BYTES = 1 << 22
#: Chunks that are encoded in one string.
TOGETHER = 256
#: Bytes of text that are aligned at once (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20
#: Links that are listed at once.
LINKS_AT_ONCE = 1 << 21
#: Most frequent pairs that each task holds; the others meet their counts in a join.
HELD_PAIRS = 1 << 18
#: Pairs are one number: A's id times this plus B's id.
PAIR = 1 << 20

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """One tokenizer: ids of chunks and the bytes of each id."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True  # their strings are plain text
            byte = _byte_of_char()
            names = {i: t for t, i in tokenizer.get_vocab().items()}
            self.bytes = [bytes(byte[c] for c in names[i]) if i in names and all(c in byte for c in names[i]) else b"" for i in range(max(names) + 1)]
            self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            self.bytes = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
            # it adds the space before a text itself
            self.encode = lambda texts: model.encode([t[1:] for t in texts], num_threads=1)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.clear()

    def learn(self, plain: list[str], others: list[str]) -> np.ndarray:
        """Append the ids of new chunks; whether each joins to the chunk's bytes.

        Chunks that begin and end as texts are cut (``plain``) are encoded many at a time, and the
        ids are dealt out by bytes."""
        got = np.array([i for x in self.encode(["".join(plain[k : k + TOGETHER]) for k in range(0, len(plain), TOGETHER)]) for i in x], np.int32)
        whole = "".join(plain).encode()
        stop = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in plain], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(self.size[got])])
        at = np.searchsorted(ends, stop)
        if plain and (b"".join(map(self.bytes.__getitem__, got.tolist())) != whole or (ends[at] != stop).any()):
            return self.learn([], plain + others)
        rest = self.encode(others)
        self.start = np.concatenate([self.start, np.concatenate([at, len(got) + np.cumsum([len(x) for x in rest], dtype=np.int64)]) + self.start[-1]])
        self.ids = np.concatenate([self.ids, got, np.array([i for x in rest for i in x], np.int32)])
        return np.array([True] * len(plain) + [b"".join(map(self.bytes.__getitem__, x)) == c.encode() for x, c in zip(rest, others, strict=True)], bool)

    def clear(self) -> None:
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)


class Encoders:
    """Both sides, with the ids of the chunks seen lately.

    A text is cut before a single space between two visible ASCII characters. There both tokenizers
    begin a token whatever surrounds it, so a chunk's ids do not depend on its neighbours.
    """

    def __init__(self, a: str, b: str):
        self.sides = (Side(a), Side(b))
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.fine, self.held = np.zeros(0, bool), 0
        for s in self.sides:
            s.clear()

    def _learn(self, chunks: list[str]) -> None:
        plain, others = [], []
        for c in chunks:
            (plain if len(c) > 1 and "!" <= c[1] <= "~" and "!" <= c[-1] <= "~" else others).append(c)
        fine = np.logical_and(*[s.learn(plain, others) for s in self.sides])
        self.at.update(zip(plain + others, range(len(self.at), len(self.at) + len(chunks)), strict=True))
        self.fine, self.held = np.concatenate([self.fine, fine]), self.held + sum(map(len, chunks))

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each side ids, byte ends within the slice and rows of all tokens. A row that holds the
        added space alone, or whose tokens' bytes differ from it on a side, has none."""
        if self.held > CACHED_BYTES:
            self.clear()
        cut = np.zeros(len(data), bool)
        cut[1:-1] = (data[1:-1] == 0x20) & _VISIBLE[data[:-2]] & _VISIBLE[data[2:]]
        cut[offs[1:-1]] = False
        cut[offs[:-1]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        coded = ts.words_array(data, start, end).dictionary_encode()
        words = coded.dictionary.to_pylist()
        place = np.fromiter((self.at.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            self._learn(fresh)
            place[new] = [self.at[w] for w in fresh]
        at = place[coded.indices.to_numpy()]
        row = np.searchsorted(offs, start, side="right") - 1
        usable = np.diff(offs) > 1
        usable[row[~self.fine[at]]] = False
        take = usable[row]
        at, row, start = at[take], row[take], start[take]
        out = []
        for s in self.sides:
            n = s.start[at + 1] - s.start[at]
            ahead = np.cumsum(n) - n
            ids = s.ids[np.repeat(s.start[at] - ahead, n) + np.arange(n.sum())]
            size = s.size[ids]
            ends = np.cumsum(size)
            # a skipped row leaves a gap, so ends count from each chunk's start
            first = np.concatenate([[0], ends])[ahead] if len(n) else np.zeros(0, np.int64)
            out.append((ids, ends - np.repeat(first, n) + np.repeat(start, n), np.repeat(row, n)))
        return out


def _encoders(a: str, b: str) -> Encoders:
    """The worker process's own encoders: they outlive tasks, so vocabularies are loaded once."""
    store = vars(sys.modules.setdefault("marketlens_worker", ModuleType("marketlens_worker")))
    if (a, b) not in store:
        store[a, b] = Encoders(a, b)
    return store[a, b]


def overlaps(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], sizes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Pairs (A's place, B's place) of tokens that share a byte, each once.

    Each token's start lies in one token of the other side, found by ``merge_asof`` on starts keyed
    by row; two tokens overlap if one of them starts inside the other.
    """
    frames = []
    for k, (ids, ends, row) in enumerate((a, b)):
        start = ends - sizes[k][ids]
        frames.append(pd.DataFrame({"start": start, "row": row, f"place{k}": np.arange(len(ids)), f"start{k}": start}))
    one = pd.merge_asof(frames[0], frames[1], on="start", by="row")
    two = pd.merge_asof(frames[1], frames[0], on="start", by="row")
    two = two[two["start"] != two["start0"]]  # equal starts are found from both sides
    return np.concatenate([t[["place0", "place1"]].to_numpy(np.int64) for t in (one, two)])


def groups(pairs: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token on both sides: a group ends where an overlapping pair ends on both."""
    closes = pairs[a_ends[pairs[:, 0]] == b_ends[pairs[:, 1]]]
    out = []
    for k, n in enumerate((len(a_ends), len(b_ends))):
        last = np.zeros(n, np.int64)
        last[closes[:, k]] = 1
        out.append(np.cumsum(last) - last)
    return out[0], out[1]


def _listed(side_a, side_b, g_a: np.ndarray, g_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, pair and number of the links of distinct ids of each group, a bounded number at once."""
    def distinct(ids, row, g):
        key, n = np.unique(g * np.int64(PAIR) + ids, return_counts=True)
        return key // PAIR, key % PAIR, n

    (ga, ia, na), (gb, ib, nb) = distinct(side_a[0], side_a[2], g_a), distinct(side_b[0], side_b[2], g_b)
    row_of = np.zeros(int(g_a[-1]) + 1 if len(g_a) else 0, np.int64)
    row_of[g_a] = side_a[2]
    first = np.searchsorted(gb, np.arange(len(row_of) + 1))
    width = np.diff(first)[ga]
    total = np.cumsum(width)
    lo = 0
    while lo < len(ga):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + LINKS_AT_ONCE, side="right")))
        w = width[lo:hi]
        left = np.repeat(np.arange(lo, hi), w)
        right = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[ga[lo:hi]], w)
        yield row_of[ga[left]], ia[left] * PAIR + ib[right], na[left] * nb[right]
        lo = hi


def links(side_a, side_b, g_a: np.ndarray, g_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair (distinct within a row) and number of links, sorted by row and pair."""
    row, pair, n = (np.zeros(0, np.int64) for _ in range(3))
    for r, p, m in _listed(side_a, side_b, g_a, g_b):
        row, pair, n = np.concatenate([row, r]), np.concatenate([pair, p]), np.concatenate([n, m])
        order = np.lexsort((pair, row))
        row, pair, n = row[order], pair[order], n[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])])
        row, pair, n = row[new], pair[new], np.add.reduceat(n, np.flatnonzero(new))
    return row, pair, n


@functools.lru_cache(maxsize=2)
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of the numbers below n in cells of eight bytes, and their widths."""
    cells = np.frombuffer("".join(f"{i:<8}" for i in range(n)).encode(), np.uint8).reshape(-1, 8)
    return cells, (cells != 0x20).sum(axis=1).astype(np.int8)


def group_texts(side_a, side_b, g_a: np.ndarray, g_b: np.ndarray, rows: int) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` for each row, of ids of at most seven digits."""
    ids = np.concatenate([side_a[0], side_b[0]])
    where = np.concatenate([g_a * 2, g_b * 2 + 1])
    order = np.argsort(where, kind="stable")
    ids, where, row = ids[order], where[order], np.concatenate([side_a[2], side_b[2]])[order]
    last = np.append(where[1:] != where[:-1], True)
    mark = np.where(last, np.where(where % 2 == 0, ord("|"), ord(";")), ord(","))
    cells, widths = _digits(1 << int(ids.max(initial=0)).bit_length())
    cell, width = cells[ids], widths[ids]
    cell[np.arange(len(ids)), width] = mark
    text = cell[np.arange(8, dtype=np.int8) <= width[:, None]].tobytes()
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, width + 1.0, rows))]).astype(np.int64).tolist()
    return [text[x : max(x, y - 1)] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def _read(docs: DataFrame, a: str, b: str, schema: str, columns: Callable[..., dict[str, pa.Array]]) -> DataFrame:
    """doc_id and the given columns of every row, a slice of texts at a time."""
    doc_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders(a, b)
        sizes = (encode.sides[0].size, encode.sides[1].size)
        for batch in batches:
            text = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            blank = pa.array([""], pa.large_string())[0]
            spaced = pc.binary_join_element_wise(blank, text, pa.array([" "], pa.large_string())[0])
            for lo, hi, data, offs in ts.text_slices(spaced, SLICE_BYTES):
                one, two = encode(data, offs)
                pairs = overlaps(one, two, sizes)
                got = columns(offs[:-1], one, two, pairs, *groups(pairs, one[1], two[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *got.values()], ["doc_id", *got])
                del data, offs, one, two, pairs, got
        encode.clear()  # the next stages run in the same worker
        give_back()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {doc_type}, {schema}")


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, a_ids, a_ends (byte ends in space and text), a_groups (each token's group, from 0),
    the same of b, and overlaps (places in A and B of tokens that share a byte) of every row.

    A null or empty text, and one that either tokenizer does not give back byte for byte, has no
    tokens. Repeated rows and null ids are kept as they are, other columns ignored; an empty table
    gives an empty result. Memory follows a slice of SLICE_BYTES or the longest text.
    """

    def columns(starts, one, two, pairs, g_a, g_b):
        rows, out, first = len(starts), {}, []
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        for name, (ids, ends, row), g in (("a", one, g_a), ("b", two, g_b)):
            at = np.searchsorted(row, np.arange(rows + 1))
            first.append(at)
            lists = lambda x, at=at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x))
            out |= {f"{name}_ids": lists(ids.astype(np.int32)), f"{name}_ends": lists(ends - starts[row]),
                    f"{name}_groups": lists(g - np.append(g, 0)[at[:-1]][row])}
        row = one[2][pairs[:, 0]]
        places = [pa.array((pairs[:, k] - first[k][row]).astype(np.int32)) for k in (0, 1)]
        bounds = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
        return out | {"overlaps": pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(places, ["a", "b"]))}

    schema = ", ".join(f"{x}_ids array<int>, {x}_ends array<long>, {x}_groups array<long>" for x in "ab")
    return _read(docs, a, b, f"{schema}, overlaps array<struct<a: int, b: int>>", columns)


def linked(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_overlaps, n_links, groups_sha256 of every row, and its distinct
    linked id pairs (a, b) with the number of their links (n)."""

    def columns(starts, one, two, pairs, g_a, g_b):
        rows = len(starts)
        row, pair, n = links(one, two, g_a, g_b)
        bounds = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
        lists = lambda x: pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32)))
        count = lambda r, w=None: pa.array(np.bincount(r, w, rows).astype(np.int64))
        closing = np.append(g_a[1:] != g_a[:-1], True)[: len(g_a)]
        texts = group_texts(one, two, g_a, g_b, rows)
        return {"n_a": count(one[2]), "n_b": count(two[2]), "n_groups": count(one[2][closing]), "n_overlaps": count(one[2][pairs[:, 0]]),
                "n_links": count(row, n), "groups_sha256": pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts]),
                "a": lists(pair // PAIR), "b": lists(pair % PAIR), "n": lists(n)}

    schema = "n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>"
    return _read(docs, a, b, schema, columns)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row within the batch, pair and number of links of all pairs of a batch of ``linked``."""
    a, b, n = (batch.column(batch.schema.get_field_index(c)) for c in "abn")
    row = np.repeat(np.arange(len(batch)), pc.list_value_length(a).to_numpy(zero_copy_only=False))
    a, b, n = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b, n))
    return row, a * PAIR + b, n


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, docs (documents that hold the pair linked), best (no pair of that A id has more) from
    the rows of ``linked``. Pairs are counted in each batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, docs = np.unique(_flat(batch)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(docs)], ["pair", "docs"])
        give_back()

    counts = found.select("a", "b", "n").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = counts.select("pair", F.expr(f"int(pair div {PAIR})").alias("a"), F.expr(f"int(pair % {PAIR})").alias("b"), "docs")
    # an A id has at most as many partners as B has ids
    most = F.max("docs").over(Window.partitionBy("a"))
    return counts.withColumn("best", F.col("docs") == most)


def summed(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_overlaps, n_links, n_best, count_sum, groups_sha256 of every row.

    Aligned rows are written once. The counts of the HELD_PAIRS most frequent pairs go to every
    task; other pairs, whose number grows with the corpus, meet their counts in a join by pair.
    Rows are as in :func:`align`.
    """
    spark = docs.sparkSession
    found = written(linked(docs, a, b).withColumn("rid", F.monotonically_increasing_id()))
    counts = written(pair_counts(found))
    held = counts.orderBy(F.desc("docs"), "pair").limit(HELD_PAIRS).select("pair", "docs", "best").toPandas().sort_values("pair")
    table = shipped(spark, [held[c].to_numpy() for c in ("pair", "docs", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs_, best = table()
        for batch in batches:
            row, pair, n = _flat(batch)
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            at = at[known]
            total = np.bincount(row[known], docs_[at] * n[known], len(batch)) if known.any() else np.zeros(len(batch))
            top = np.bincount(row[known], best[at] * n[known], len(batch)) if known.any() else np.zeros(len(batch))
            bounds = pa.array(np.searchsorted(row[~known], np.arange(len(batch) + 1)).astype(np.int32))
            rest = pa.StructArray.from_arrays([pa.array(pair[~known]), pa.array(n[~known])], ["pair", "n"])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("rid")), pa.array(top.astype(np.int64)), pa.array(total.astype(np.int64)),
                                              pa.ListArray.from_arrays(bounds, rest)], ["rid", "n_best", "count_sum", "rest"])
        del pairs, docs_, best
        give_back()

    parts = written(found.select("rid", "a", "b", "n").mapInArrow(run, "rid long, n_best long, count_sum long, rest array<struct<pair: long, n: long>>"))
    other = parts.select("rid", F.explode("rest").alias("x")).select("rid", "x.pair", "x.n").join(counts.select("pair", "docs", "best"), "pair")
    other = other.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    sums = parts.select("rid", "n_best", "count_sum").union(other).groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    kept = found.select("doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_links", "groups_sha256", "rid")
    return kept.join(sums, "rid").select(*[c for c in kept.columns if c != "rid"], F.coalesce("n_best", F.lit(0)).alias("n_best"), "count_sum")
