"""Quality rules by repetition coverage (operator 2).

For several n, rolling hashes find the word windows that occur twice or more in a text; what share
of the text's characters lies inside such windows, or inside repeated lines, decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import give_back

#: n-gram lengths and the share of word characters allowed inside repeated ones.
MAX_COVERED = {3: 0.60, 5: 0.50, 8: 0.40, 10: 0.35}
#: Share of word characters allowed in lines equal to an earlier line.
MAX_DUP_LINE = 0.30
MIN_WORDS = 20
#: Words of the windows behind n_repeat_words, and the percentage that fails a text.
REPEAT_WORDS, REPEAT_PERCENT = 8, 30

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          + ", ".join(f"covered_{n} double" for n in MAX_COVERED)
          + ", dup_line_share double, base_failed boolean, kept boolean")


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    s = np.sort(keys)
    again = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(again):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
    return again[at] == keys


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for each row of a slice."""
    rows = len(offs) - 1
    start, end, row = ts.word_spans(data, offs)
    chars, bytes_before = ts.char_prefix(data), ts.byte_prefix(data)
    size = chars[end] - chars[start]
    per_row = lambda r, w=None: np.bincount(r, w, rows)
    n_words = per_row(row).astype(np.int64)
    word_chars = per_row(row, size).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]]}

    salt = ts.mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))
    hashes = ts.span_hash(bytes_before, start, end)
    total = np.maximum(word_chars, 1)
    covered = {}
    for n in sorted({*MAX_COVERED, REPEAT_WORDS}):
        first, h = ts.windows(hashes, row, n)
        twice = first[_repeated(h ^ salt[row[first]])]
        edge = np.zeros(len(row) + 1, np.int64)
        edge[twice] += 1
        np.subtract.at(edge, twice + n, 1)
        inside = np.cumsum(edge[:-1]) > 0
        if n == REPEAT_WORDS:
            n_repeat = per_row(row[inside]).astype(np.int64)
        covered[f"covered_{n}"] = per_row(row[inside], size[inside]) / total

    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(offs, line_start, side="right") - 1
    after = np.searchsorted(breaks, line_start)
    line_end = np.minimum(np.append(breaks, len(data))[after], offs[line_row + 1])
    before = np.searchsorted(start, line_start)
    worded = np.searchsorted(start, line_end) > before
    line_start, line_end, line_row = line_start[worded], line_end[worded], line_row[worded]
    keys = ts.span_hash(bytes_before, line_start, line_end) ^ salt[line_row]
    order = np.argsort(keys, kind="stable")
    later = order[1:][keys[order[1:]] == keys[order[:-1]]]
    words_in = np.concatenate([[0], np.cumsum(size)])
    line_chars = (words_in[np.searchsorted(start, line_end)] - words_in[np.searchsorted(start, line_start)])
    out["n_dup_lines"] = per_row(line_row[later]).astype(np.int64)
    out["n_repeat_words"] = n_repeat
    out |= {f"covered_{n}": covered[f"covered_{n}"] for n in MAX_COVERED}
    out["dup_line_share"] = per_row(line_row[later], line_chars[later]) / total
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    out["base_failed"] = failed
    kept = ~failed & (out["dup_line_share"] <= MAX_DUP_LINE)
    for n, most in MAX_COVERED.items():
        kept &= out[f"covered_{n}"] <= most
    out["kept"] = kept
    return out


def _measured(col: pa.Array) -> dict[str, np.ndarray]:
    parts = [measure(data, offs) for _, _, data, offs in ts.text_slices(col)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def score(docs: DataFrame) -> DataFrame:
    """Counts, coverage and verdict of every text: doc_id and the columns of SCHEMA.

    A null or empty text has no words and fails. Each row is judged alone: repeated rows, null ids
    and any other columns of ``docs`` (whatever their names) make no difference. An empty table
    gives an empty result. A text of any length is read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = _measured(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, got.values())], ["doc_id", *got])
        give_back()

    ids = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {ids}, {SCHEMA}")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged; repeated rows pass or fail alike, and a
    null or empty text fails. An empty table gives an empty result."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_measured(b.column(at))["kept"]))
        give_back()

    return docs.mapInArrow(run, docs.schema)
