"""Quality classifier: a generalised additive model with pairwise interactions (operator 3).

Features of a text go into bins. Cyclic boosting visits one feature after another, then one pair
of features after another, fits a shallow tree to the current gradients over that feature's bins
and adds it to the feature's table. A score is the sum of the tables' entries, so it needs only
bins and additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import hash_share, shipped
from .quality_rules import measure

#: Labelled rows that the model is fitted on, about.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 40, 0.1
LEAVES, RIDGE = 3, 1.0
THRESHOLD = 0.3

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "line": [10],
    "stop": map(ord, ".?"), "comma": map(ord, ",;:"), "bang": map(ord, "!"), "bar": map(ord, "|"),
    "symbol": map(ord, "#*$%&<>@+=_~^\\/{}[]"), "high": range(128, 256),
}
FEATURES = ["log_words", "word_length", "distinct", "repeats", "capitals", "one_case", "short_words", "long_words",
            "words_a_line", "covered_3", "covered_8", "dup_line_share", *_CLASSES]
_CLASS = np.zeros(256, np.uint8)
for _i, _k in enumerate(_CLASSES, 1):
    _CLASS[list(_CLASSES[_k])] = _i
_NAMES = list(_CLASSES)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a slice; 0 throughout where there is no word."""
    rows = len(offs) - 1
    rules = measure(data, offs)
    start, end, row = ts.word_spans(data, offs)
    per_row = lambda r, w=None: np.bincount(r, w, rows)
    n = np.maximum(rules["n_words"], 1)
    size = np.diff(offs)
    byte_row = np.repeat(np.arange(rows), size)
    kinds = np.bincount(byte_row * 16 + _CLASS[data], minlength=rows * 16).reshape(rows, 16)
    hashes = ts.span_hash(ts.byte_prefix(data), start, end)
    again = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    salted = hashes ^ ts.mix(row.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(salted, return_index=True)
    upper = np.concatenate([[0], np.cumsum(_CLASS[data] == 1)])
    lower = np.concatenate([[0], np.cumsum(_CLASS[data] == 2)])
    capital = _CLASS[data[start]] == 1 if len(start) else np.zeros(0, bool)
    length = end - start
    all_upper = (upper[end] - upper[start] > 1) & (lower[end] == lower[start])
    out = {
        "log_words": np.log1p(rules["n_words"]), "word_length": rules["word_chars"] / n,
        "distinct": per_row(row[first]) / n, "repeats": per_row(row[1:][again]) / n,
        "capitals": per_row(row[capital]) / n, "one_case": per_row(row[all_upper]) / n,
        "short_words": per_row(row[length <= 3]) / n, "long_words": per_row(row[length >= 12]) / n,
        "words_a_line": rules["n_words"] / (kinds[:, 1 + _NAMES.index("line")] + 1),
        "covered_3": rules["covered_3"], "covered_8": rules["covered_8"], "dup_line_share": rules["dup_line_share"],
    } | {k: kinds[:, i] / np.maximum(size, 1) for i, k in enumerate(_NAMES, 1)}
    return np.stack([out[k] for k in FEATURES], axis=1) * (rules["n_words"] > 0)[:, None]


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """Values of a tree of at most ``leaves`` leaves over ordered bins, split greedily."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    total = lambda c, a, b: c[b - 1] - (c[a - 1] if a else 0)
    worth = lambda s, w: s * s / (w + RIDGE)
    spans = [(0, len(grad))]
    while len(spans) < leaves:
        best = (1e-9, None, 0)
        for a, b in spans:
            if b - a < 2:
                continue
            gl = g[a : b - 1] - (g[a - 1] if a else 0)
            hl = h[a : b - 1] - (h[a - 1] if a else 0)
            gt, ht = total(g, a, b), total(h, a, b)
            gain = worth(gl, hl) + worth(gt - gl, ht - hl) - worth(gt, ht)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (a, b), a + 1 + at)
        if best[1] is None:
            break
        (a, b), cut = best[1], best[2]
        spans.remove((a, b))
        spans += [(a, cut), (cut, b)]
    out = np.zeros(len(grad))
    for a, b in spans:
        out[a:b] = total(g, a, b) / (total(h, a, b) + RIDGE)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree of a split on the first axis and one on the second in each half; its gain."""
    cells = lambda c: c.cumsum(0)
    worth = lambda s, w: s * s / (w + RIDGE)
    best, out = 0.0, np.zeros_like(grad)
    top_g, top_h = cells(grad), cells(hess)
    for cut in range(1, len(grad)):
        gain, values = 0.0, np.zeros_like(grad)
        for part, (gs, hs) in ((slice(0, cut), (top_g[cut - 1], top_h[cut - 1])), (slice(cut, None), (top_g[-1] - top_g[cut - 1], top_h[-1] - top_h[cut - 1]))):
            gc, hc = gs.cumsum(), hs.cumsum()
            gains = worth(gc[:-1], hc[:-1]) + worth(gc[-1] - gc[:-1], hc[-1] - hc[:-1])
            at = int(gains.argmax()) + 1
            gain += gains[at - 1]
            values[part, :at] = gc[at - 1] / (hc[at - 1] + RIDGE)
            values[part, at:] = (gc[-1] - gc[at - 1]) / (hc[-1] - hc[at - 1] + RIDGE)
        if gain > best:
            best, out = gain, values
    return out, best - worth(grad.sum(), hess.sum())


@dataclass
class Additive:
    """Edges of the bins, the tables of features and of pairs, and the constant."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)]

    def coarse(self, i: int, bins: np.ndarray) -> np.ndarray:
        return bins * PAIR_BINS // (len(self.edges[i]) + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        bins = self.bins(x)
        for b, t in zip(bins, self.tables, strict=True):
            z += t[b]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[self.coarse(i, bins[i]), self.coarse(j, bins[j])]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit to features and labels 0 or 1; without rows, or with one label, the score is constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(share / (1 - share))))
    if len(y) < 2 or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = model.bins(x)
    z = np.full(len(y), model.base)

    def gradients(at: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.bincount(at, y - p, cells), np.bincount(at, p * (1 - p), cells)

    for _ in range(ROUNDS):
        for b, t in zip(bins, model.tables, strict=True):
            step = RATE * _tree(*gradients(b, len(t)), LEAVES)
            t += step
            z += step[b]
    flat = lambda i, j: model.coarse(i, bins[i]) * PAIR_BINS + model.coarse(j, bins[j])
    grid = lambda at: [c.reshape(PAIR_BINS, PAIR_BINS) for c in gradients(at, PAIR_BINS**2)]
    gains = sorted(((_pair_tree(*grid(flat(i, j)))[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in gains[:PAIRS]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    at = [flat(i, j) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, t in zip(at, model.pair_tables, strict=True):
            step = RATE * _pair_tree(*grid(k))[0]
            t += step
            z += step.ravel()[k]
    return model


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in ts.text_slices(b.column(1)):
                x = features(data, offs)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), flat], ["doc_id", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Additive:
    """Fit on about ``sample`` labelled rows of ``docs`` that are ``usable``, picked by a hash of the id.

    Labels other than 0 and 1 are left out; an id with several labels counts with each.
    """
    marked = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("y"))
    rate = min(1.0, sample / max(1, marked.count()))
    drawn = featured(docs.where(usable & (hash_share(F.lit("quality"), F.col("doc_id").cast("long")) < rate)))
    rows = drawn.join(marked, F.col("doc_id") == F.col("_id")).select("doc_id", "x", "y").toPandas().sort_values(["doc_id", "y"])
    return boost(np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES)), rows["y"].to_numpy(float))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and predicted (1 from THRESHOLD up) of every row.

    Null and empty texts have all features 0 and get a score as any other. Rows are judged one by
    one: repeated rows and null ids are kept, other columns are ignored, an empty table gives an
    empty result. Equal texts get equal scores.
    """
    shared = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shared()
        for b in batches:
            for lo, hi, data, offs in ts.text_slices(b.column(1)):
                p = learnt.score(features(data, offs))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
