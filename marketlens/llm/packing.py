"""Shortest-pack-first histogram packing (operator 6).

Documents are tokenized and cut into pieces of at most one sequence. The driver sees only the
histogram of piece lengths (at most ``size`` numbers): lengths go in longest first, each into the
emptiest open packs, and what is kept is how often each packing pattern is used. Pieces then find
their sequence from their length and their rank among pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import checkpointed, give_back, with_rank

#: Ids of one sequence, and the id that ends a document.
SIZE, END = 2048, 1
#: Distinct parts of words whose ids a Python worker remembers.
CACHED_PARTS = 250_000
SLICE_BYTES = 2 << 20


#: Class of a byte: 0 white space, 1 ASCII letter, 2 ASCII punctuation but for the apostrophe
#: (which can begin a token that holds letters), 3 any other.
CLASS = np.full(256, 3, np.uint8)
CLASS[ts.SPACE] = 0
CLASS[[c for c in range(128) if chr(c).isalpha()]] = 1
CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 2
#: By the classes of a byte and the next: 1 if a part ends between them, plus 2 if one starts.
EDGE = np.array([[0, 2, 2, 2], [1, 0, 3, 0], [1, 3, 0, 0], [1, 0, 0, 0]], np.uint8).ravel()


def part_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each part of a word: cut at white space and where letter meets mark."""
    kind = np.zeros(len(data) + 2, np.uint8)
    np.take(CLASS, data, out=kind[1:-1])
    edge = EDGE[kind[:-1] * np.uint8(4) + kind[1:]]  # edge[i] lies before byte i
    cuts = np.unique(offs)
    edge[cuts] = (kind[cuts] != 0) + 2 * (kind[cuts + 1] != 0).astype(np.uint8)
    return np.flatnonzero(edge & 2), np.flatnonzero(edge & 1)


class WordIds:
    """Ids of whole texts, encoding each distinct part of a word once.

    The tokenizer drops white space and splits where an ASCII letter meets ASCII punctuation, so
    the ids of a text are those of such parts in order. A word with the start of a special token
    (``<|``) is left whole and in its own case. The store is emptied when it holds CACHED_PARTS.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        bare = Tokenizer(tokenizer.model)
        bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encode, self.encode_plain = tokenizer.encode_batch_fast, bare.encode_batch_fast
        vocabulary = tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _store(self, parts: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        self.at.update(zip(parts, range(len(self.at), len(self.at) + len(parts)), strict=True))
        self.start = np.concatenate([self.start, np.cumsum(size) + self.start[-1]])
        self.ids = np.concatenate([self.ids, ids])

    def _learn(self, parts: list[str]) -> None:
        """Words of small letters alone, which the tokenizer neither changes nor splits, skip its
        normalizer and its pattern and go in one call; the last id of each ends a word."""
        known = len(self.at)
        plain = [w for w in parts if w.isalpha() and w.islower() and is_normalized("NFC", w) and w == w.lower()]
        if plain:
            ids = np.array(self.encode_plain([" ".join(plain)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(plain):
                self._store(plain, np.diff(ends, prepend=0), ids)
        rest = [w for w in parts if w not in self.at] if len(self.at) < known + len(parts) else []
        if rest:
            got = [e.ids for e in self.encode(rest, add_special_tokens=False)]
            self._store(rest, np.array([len(x) for x in got]), np.array([i for x in got for i in x], np.uint32))

    def _places(self, parts: list[str]) -> np.ndarray:
        if len(self.at) > CACHED_PARTS:
            self._clear()
        place = np.fromiter(map(self.at.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(place < 0)
        if len(new):
            words = [parts[i] for i in new.tolist()]
            self._learn(words)
            place[new] = [self.at[w] for w in words]
        return place

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, each row closed by END, and the rows' offsets in them."""
        rows = len(offs) - 1
        part, stop = part_spans(data, offs)
        lower = ts.LOWER[data]
        special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        if len(special):
            start, end, _ = ts.word_spans(data, offs)
            whole = np.unique(np.searchsorted(start, special, side="right") - 1)
            for a, b in zip(start[whole].tolist(), end[whole].tolist(), strict=True):
                lower[a:b] = data[a:b]
            inner = lambda at: np.isin(np.searchsorted(start, at, side="right") - 1, whole)
            part = part[~inner(part) | np.isin(part, start)]
            stop = stop[~inner(stop - 1) | np.isin(stop, end)]
        row = np.searchsorted(offs, part, side="right") - 1
        if len(part):
            coded = ts.words_array(lower, part, stop).dictionary_encode()
            place = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        else:
            place = np.zeros(0, np.int64)
        size = self.start[place + 1] - self.start[place]
        bounds = np.zeros(rows + 1, np.int64)
        np.cumsum(np.bincount(row, size, rows).astype(np.int64) + 1, out=bounds[1:])
        out = np.empty(bounds[-1], np.uint32)
        out[bounds[1:] - 1] = END
        ahead = np.cumsum(size) - size
        body = np.ones(len(out), bool)
        body[bounds[1:] - 1] = False
        take = np.repeat(self.start[place] - ahead, size)
        take += np.arange(len(take))
        out[body] = self.ids[take]
        return out, bounds


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, and ids if asked for."""
    doc_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {doc_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(tokenizer)
        for b in batches:
            for lo, _, data, offs in ts.text_slices(b.column(1), SLICE_BYTES):
                ids, bounds = encode(data, offs)
                total = np.diff(bounds)
                n = -(-total // size)
                row = np.repeat(np.arange(len(total)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(size, total[row] - start)
                first = bounds[row] + start
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                cols = [b.column(0).take(pa.array(row + lo)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[row])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        del encode  # a vocabulary and its cache are not kept between tasks
        give_back()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def patterns(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Shortest-pack-first over a histogram of lengths: (times used, lengths in order).

    Longest lengths are placed first, each copy into the open pack with the most room, or into a
    new pack if even that has too little. Packs with the same contents are counted, not listed;
    work follows the number of lengths and patterns, not the number of pieces.
    """
    open_packs: dict[int, list[tuple[int, tuple]]] = {}  # room -> patterns; contents as linked pairs
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = max(open_packs, default=0)
            if room < length:
                # full rows of this length at once; the last new pack may hold fewer
                open_packs.setdefault(size - length, []).append((left, (length, None)))
                left = 0
                continue
            times, contents = open_packs[room].pop()
            used = min(times, left)
            if times > used:
                open_packs[room].append((times - used, contents))
            elif not open_packs[room]:
                del open_packs[room]
            open_packs.setdefault(room - length, []).append((used, (length, contents)))
            left -= used
    out = []
    for room in sorted(open_packs):
        for times, contents in open_packs[room]:
            lengths = []
            while contents:
                lengths.append(contents[0])
                contents = contents[1]
            out.append((times, lengths[::-1]))
    return out


def _places(found: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each run of ranks."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for times, lengths in found:
        offset = 0
        for length in lengths:
            runs.setdefault(length, []).append((seen.get(length, 0), sequence, offset))
            seen[length] = seen.get(length, 0) + times
            offset += length
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece, the END id alone. Rows that repeat a doc_id are packed each
    for itself; a null doc_id stays null. Pieces equal in every column are interchangeable. Other
    columns of ``docs`` are ignored, whatever their names. An empty table gives an empty result.
    Only the histogram of lengths, at most ``size`` rows, reaches the driver.
    """
    cut = checkpointed(pieces(docs, tokenizer, size, with_ids))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(patterns(counts, size))
    ranked = with_rank(cut, ["length"], ["doc_id", "start", "ids_crc32"], sum(counts.values()), "rank")
    columns = [c for c in cut.columns]
    return _placed(ranked, columns, places)


def _placed(ranked: DataFrame, columns: list[str], places: dict) -> DataFrame:
    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                first, base, inside = places[int(k)]
                run_of = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = base[run_of] + rank[at] - first[run_of]
                offset[at] = inside[run_of]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)
