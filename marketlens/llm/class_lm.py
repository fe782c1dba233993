"""Brown class-based word n-grams (operator 4).

Exchange clustering puts words into classes so that the class bigrams of the corpus are as likely
as possible. A text's probability is the product, over its tokens, of the transition between
classes and the emission of the word from its class. All counts cover all training text, every word
has a class of its own finding, and the number of classes grows with the vocabulary.

The classes are seeded by exchange over *units* (a frequent word, or all others with an ending). Then
sweeps over the corpus count the classes beside every word of the lexicon, the LEXICON most frequent
words that tasks hold, and move the words, half of them at a time, to their best class. Words beyond
the lexicon are a table: each gets the class that its predecessors favour. As a predecessor such a
word stands for the class of its ending, which a task knows without the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import checkpointed, shipped, written

#: Frequent words that tasks hold; the counts of other words come by a join.
LEXICON = 250_000
#: Words and endings with a unit of their own in the seed of the classes.
UNIT_WORDS, UNIT_ENDINGS = 1000, 250
#: Classes for each unit of the cube root of the vocabulary, and the least number of classes.
CLASS_RATE, LEAST_CLASSES = 2.0, 15
ENDING = 2
#: Sweeps over the units, and over the words of the lexicon (each moves half of them).
SWEEPS, WORD_SWEEPS = 6, 2
#: Neighbours that a task holds before it sends their sums, and cells compared at once.
HELD, CELLS = 1 << 21, 1 << 21
#: Keys that the class bigrams are spread over.
TABLE_PARTS = 64
#: Weight of the class frequencies in the transition probabilities.
SMOOTHING = 10.0
SLICE_BYTES = 4 << 20


def _coded(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a slice, the place of each token in them, and the tokens' rows."""
    lower = ts.LOWER[data]
    start, end, row = ts.word_spans(lower, offs)
    coded = ts.words_array(lower, start, end).dictionary_encode()
    return coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64), row


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all rows of ``texts`` (one text column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offs in ts.text_slices(b.column(0), SLICE_BYTES):
                words, at, _ = _coded(data, offs)
                if len(words):
                    yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(at, minlength=len(words)))], ["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Units:
    """Words and endings with units: words first, then endings, then the rest, then the end."""

    lexicon: pa.Array
    counts: np.ndarray
    unit_of: np.ndarray
    endings: dict[str, int]
    n: int

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place in the lexicon (-1: not there) and unit of each word."""
        at = pc.fill_null(pc.index_in(words, value_set=self.lexicon), -1).to_numpy().astype(np.int64) if len(self.lexicon) else np.full(len(words), -1)
        unit = np.where(at >= 0, self.unit_of[at] if len(self.unit_of) else 0, self.n - 2)
        far = np.flatnonzero(at < 0)
        if len(far) and self.endings:
            ends = pc.utf8_slice_codeunits(words.take(pa.array(far)), -ENDING)
            which = pc.fill_null(pc.index_in(ends, value_set=pa.array(list(self.endings), pa.string())), -1).to_numpy()
            unit[far] = np.append(np.fromiter(self.endings.values(), np.int64), self.n - 2)[which]
        return at, unit

    def stream(self, of_words: np.ndarray, at: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Units of all tokens of a slice with the end before, between and after its rows."""
        out = np.full(len(at) + rows + 1, self.n - 1, np.int64)
        out[np.arange(len(at)) + row + 1] = of_words[at]
        return out


def bigrams(texts: DataFrame, units: Units) -> np.ndarray:
    """How often unit j follows unit i, over all rows: a task adds up and sends what is not zero."""
    shared = shipped(texts.sparkSession, units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = shared()
        total = np.zeros(u.n * u.n, np.int64)
        for b in batches:
            for _, _, data, offs in ts.text_slices(b.column(0), SLICE_BYTES):
                words, at, row = _coded(data, offs)
                s = u.stream(u.lookup(words)[1], at, row, len(offs) - 1)
                total += np.bincount(s[:-1] * u.n + s[1:], minlength=len(total))
        cells = np.flatnonzero(total)
        for k in range(0, len(cells), 1 << 16):
            part = cells[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["cell", "n"])

    sums = texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(units.n * units.n, np.int64)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(units.n, units.n)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def class_number(words: int) -> int:
    """Classes besides the one of the text's end; the table of class bigrams grows with words ** (2 / 3)."""
    return max(LEAST_CLASSES, math.ceil(CLASS_RATE * words ** (1 / 3)))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit. The last unit, the end, keeps class 0 for itself.

    Units start dealt out by frequency. In each sweep every unit, the most frequent first, moves to
    the class where the class bigrams' log likelihood is highest, until no unit moves.
    """
    units = len(pairs)
    freq = pairs.sum(axis=0)
    order = [u for u in np.argsort(-freq, kind="stable").tolist() if u != units - 1]
    of = np.zeros(units, np.int64)
    of[order] = 1 + np.arange(len(order)) % classes
    k = classes + 1
    hot = np.eye(k)[of]
    out_to, in_from = pairs @ hot, pairs.T @ hot  # by class, of each unit's successors and predecessors
    table = hot.T @ out_to
    every = np.arange(k)
    for _ in range(sweeps):
        moved = False
        for u in order:
            if not freq[u]:
                continue
            old, own = of[u], pairs[u, u]
            right, left = out_to[u].copy(), in_from[u].copy()
            right[old] -= own
            left[old] -= own
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= own
            rows, cols = table.sum(axis=1) + left, table.sum(axis=0) + right  # with the pairs that lead to and from the unit
            gain = (_xlogx(table + right) - _xlogx(table)).sum(axis=1) + (_xlogx(table + left[:, None]) - _xlogx(table)).sum(axis=0)
            d = table[every, every]
            # the cell of a class with itself gets both changes and the unit's own pairs at once
            gain += _xlogx(d + right + left + own) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            grow_r, grow_l = right.sum() + own, left.sum() + own
            gain -= _xlogx(rows + grow_r) - _xlogx(rows) + _xlogx(cols + grow_l) - _xlogx(cols)
            gain[0] = -np.inf
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else old
            table[new] += right
            table[:, new] += left
            table[new, new] += own
            if new != old:
                of[u], moved = new, True
                out_to[:, old] -= pairs[:, u]
                out_to[:, new] += pairs[:, u]
                in_from[:, old] -= pairs[u]
                in_from[:, new] += pairs[u]
        if not moved:
            break
    return of


def log_likelihood(table: np.ndarray) -> float:
    """What exchange raises, but for the words' own counts: log likelihood of class bigrams."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def neighbours(texts: DataFrame, units: Units, class_of: np.ndarray, k: int, moving: tuple[int, int] | None) -> DataFrame:
    """word, place, found: class counts beside words over all rows of ``texts``; found lists cell, n.

    Rows with a place below 0 hold the class bigrams, first * k + second, in some parts. With
    ``moving`` (i, m) there are the classes before (cell below k) and after (from k) each word of the
    lexicon whose place leaves i when divided by m; without it, the classes before each word outside
    the lexicon (place 0), whose own bigrams are then left out. A task sums up before it sends, and
    counts go to the task of their word at once, so the rows are shuffled a single time.
    """
    shared = shipped(texts.sparkSession, (units, class_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, of = shared()
        own, total = len(u.lexicon), np.zeros(k * k, np.int64)
        held: list[np.ndarray] = []

        def sums() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.string()), pa.array(keys // (2 * k)), pa.array(keys % (2 * k)), pa.array(n)], names)

        for b in batches:
            for _, _, data, offs in ts.text_slices(b.column(0), SLICE_BYTES):
                words, at, row = _coded(data, offs)
                s = u.stream(u.lookup(words)[1], at, row, len(offs) - 1)
                c = of[s]
                if moving is None:
                    token = u.stream(np.arange(len(words)), at, row, len(offs) - 1)  # places in ``words``; meaningless at ends
                    far = (s >= own) & (s < u.n - 1)
                    total += np.bincount((c[:-1] * k + c[1:])[~far[1:]], minlength=k * k)
                    far = np.flatnonzero(far)
                    keys, n = np.unique(token[far] * k + c[far - 1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(keys // k)), pa.array(np.zeros(len(keys), np.int64)), pa.array(keys % k), pa.array(n)], names)
                    continue
                total += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
                near = np.flatnonzero((s < own) & (s % moving[1] == moving[0]))
                held += [s[near] * 2 * k + c[near - 1], s[near] * 2 * k + k + c[near + 1]]
                if sum(map(len, held)) > HELD:
                    yield sums()
        if held:
            yield sums()
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(cells), pa.string()), pa.array(-1 - cells % TABLE_PARTS), pa.array(cells), pa.array(total[cells])], names)

    names = ["word", "place", "cell", "n"]
    sent = texts.mapInArrow(run, "word string, place long, cell long, n long").repartition("word", "place")
    sums = sent.groupBy("word", "place", "cell").agg(F.sum("n").alias("n"))
    return written(sums.groupBy("word", "place").agg(F.collect_list(F.struct("cell", "n")).alias("found")))


def _dense(cells: DataFrame, k: int) -> np.ndarray:
    """The k * k table of cell, n; a cell may come in parts."""
    got = cells.select("cell", "n").toArrow()
    return np.bincount(got["cell"].to_numpy(), got["n"].to_numpy(), k * k).reshape(k, k)


def _bigrams_of(found: DataFrame, k: int) -> np.ndarray:
    return _dense(found.where("place < 0").select(F.inline("found")), k)


def _summed(rows: np.ndarray, at: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word the sum of rows[at] over its ``sizes`` places from ``first`` on, at least one.

    The words' first rows are added, then their second ones, and so on; longer words come first.
    """
    order = np.argsort(-sizes, kind="stable")
    start, out = first[order], np.empty((len(first), rows.shape[1]))
    total = rows[at[start]]
    for j, m in enumerate(np.searchsorted(-sizes[order], -np.arange(1, sizes.max())).tolist(), 1):
        total[:m] += rows[at[start[:m] + j]]
    out[order] = total
    return out


def best_classes(table: np.ndarray, starts: np.ndarray, cell: np.ndarray, n: np.ndarray, old: np.ndarray | None) -> np.ndarray:
    """The class in which the class bigrams are likeliest, for words with the class counts cell, n.

    Word i has the counts from starts[i] to starts[i + 1]. ``old`` holds the classes under which the
    table counts the words now; None: the table does not count them. Each word is judged as if it
    moved alone; bigrams of a word with itself count with the class that it had.
    """
    k, out = len(table), np.zeros(len(starts) - 1, np.int64)
    rows, cols, both = table.sum(axis=1), table.sum(axis=0), np.concatenate([table, table.T])
    both_log, d = _xlogx(both), table.diagonal()
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + CELLS // k, side="right")) - 1)
        part = slice(starts[lo], starts[hi])
        first, sizes = starts[lo:hi] - starts[lo], np.diff(starts[lo : hi + 1])
        cells, times, every = cell[part], n[part].astype(float), np.arange(hi - lo)
        of = np.repeat(every, sizes)
        # equal counts of equal classes gain alike in every word: each such row is computed once
        kinds, alike = np.unique(n[part] * 2 * k + cells, return_inverse=True)
        at = kinds % (2 * k)
        gain = _summed(_xlogx(both[at] + (kinds // (2 * k))[:, None]) - both_log[at], alike, first, sizes)
        before_n, after_n = np.add.reduceat(times * (cells < k), first), np.add.reduceat(times * (cells >= k), first)
        # and so do equal numbers of words before, or after
        for sums, more in ((cols, before_n), (rows, after_n)):
            if more.any():
                kinds, alike = np.unique(more, return_inverse=True)
                gain -= (_xlogx(sums + kinds[:, None]) - _xlogx(sums))[alike]
        if old is not None or after_n.any():
            counts = np.zeros((hi - lo, 2 * k))
            counts[of, cells] = times
            left, right = counts[:, :k], counts[:, k:]
            # the cell of a class with itself gets the words before and after at once
            w, c = np.nonzero((left > 0) & (right > 0))
            x, y = left[w, c], right[w, c]
            gain[w, c] += _xlogx(d[c] + x + y) - _xlogx(d[c] + x) - _xlogx(d[c] + y) + _xlogx(d[c])
        if old is not None:
            was = old[lo:hi]
            # cells of the old class without the word: those that the word leaves behind
            for side, other, all_cells in ((left, right, table), (right, left, table.T)):
                at = np.flatnonzero(side[every, was])
                times_at, all_, rest = side[at, was[at]][:, None], all_cells[was[at]], np.maximum(all_cells[was[at]] - other[at], 0)
                gain[at] += _xlogx(rest + times_at) - _xlogx(rest) - _xlogx(all_ + times_at) + _xlogx(all_)
            # and those that it would come back to
            away = cells % k != was[of]
            less = np.maximum(both[cells, was[of]] - times, 0)
            own = left[every, was] + right[every, was]
            own_less = np.maximum(d[was] - own, 0)
            r, q = np.maximum(rows[was] - after_n, 0), np.maximum(cols[was] - before_n, 0)
            gain[every, was] = (np.bincount(of, (_xlogx(less + times) - _xlogx(less)) * away, hi - lo) + _xlogx(own_less + own) - _xlogx(own_less)
                                - (_xlogx(r + after_n) - _xlogx(r) + _xlogx(q + before_n) - _xlogx(q)))
        gain[:, 0] = -np.inf
        new = gain.argmax(axis=1)
        if old is not None:
            new = np.where(gain.max(axis=1) > gain[every, was] + 1e-9, new, was)
        out[lo:hi], lo = new, hi
    return out


def _chosen(lists: DataFrame, table: np.ndarray, class_of: np.ndarray | None) -> DataFrame:
    """word, place, n (the counts before it), class, found of each word; a word has at most two counts for each class."""
    shared = shipped(lists.sparkSession, (table, class_of))
    names = ["word", "place", "n", "class", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, of = shared()
        for b in batches:
            if not b.num_rows:
                continue
            word, place, found = b.columns
            flat, starts = found.flatten(), np.append(0, np.cumsum(pc.list_value_length(found).to_numpy()))
            cell, n = flat.field("cell").to_numpy(), flat.field("n").to_numpy()
            new = best_classes(t, starts, cell, n, None if of is None else of[place.to_numpy()])
            before = np.add.reduceat(n * (cell < len(t)), starts[:-1])
            yield pa.RecordBatch.from_arrays([word, place, pa.array(before), pa.array(new.astype(np.int32)), found], names)

    return lists.select("word", "place", "found").mapInArrow(run, "word string, place long, n long, class int, found array<struct<cell:long,n:long>>")


def sweep_words(texts: DataFrame, units: Units, class_of: np.ndarray, k: int, sweeps: int = WORD_SWEEPS) -> np.ndarray:
    """Classes of the units, those of the lexicon's words after ``sweeps`` moves of every second word.

    A sweep's count shows whether the one before made the class bigrams likelier; if not, the
    classes before that one are the result.
    """
    best, kept = -math.inf, class_of
    for turn in range(sweeps):
        found = neighbours(texts, units, class_of, k, (turn % 2, 2))
        table = _bigrams_of(found, k)
        now = log_likelihood(table)
        if now <= best + 1e-9 * abs(now):
            return kept
        best, kept = now, class_of
        moved = _chosen(found.where("place >= 0"), table, class_of).select("place", "class").toArrow()
        class_of = class_of.copy()
        class_of[moved["place"].to_numpy()] = moved["class"].to_numpy()
    return class_of


@dataclass
class Model:
    """What scoring needs in a task: the lexicon is bounded, the steps grow with words ** (2 / 3)."""

    units: Units
    class_of: np.ndarray
    steps: np.ndarray
    spread: np.ndarray
    texts: int

    def measure(self, data: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], pa.Array, dict[str, np.ndarray]]:
        """Sums of each row, then the words outside the lexicon: word; row, class before, class by ending, times."""
        rows, k = len(offs) - 1, len(self.spread)
        words, at, row = _coded(data, offs)
        lex, unit = self.units.lookup(words)
        classes = self.class_of[self.units.stream(unit, at, row, rows)]
        token_row = np.insert(row, np.searchsorted(row, np.arange(rows), side="right"), np.arange(rows))
        known = lex[at] >= 0
        inside = self.units.stream(lex, at, row, rows)[1:] >= 0  # ends count as inside
        steps = (self.steps[classes[:-1], classes[1:]] - self.spread[classes[1:]])[inside]
        logs = np.log10(np.append(self.units.counts, 0) + 0.5)[lex[at[known]]]
        n = np.bincount(row, minlength=rows)
        sums = {"n_tokens": n + 1, "n_known": np.bincount(row[known], minlength=rows) + (self.texts > 0),
                "logs": np.bincount(row[known], logs, rows) + np.log10(self.texts + 0.5), "steps": np.bincount(token_row[inside], steps, rows)}
        before = classes[np.arange(len(at)) + row]
        size = max(1, len(words))
        pair, times = np.unique((row[~known] * size + at[~known]) * k + before[~known], return_counts=True)
        word = pair // k % size
        own = self.class_of[unit[word]] if len(words) else word
        return sums, words.take(pa.array(word)), {"row": pair // k // size, "before": pair % k, "own": own, "times": times}


@dataclass
class Fitted:
    model: Model
    rare: DataFrame
    tokens: int
    words: int


def fit(docs: DataFrame, usable: Column) -> Fitted:
    """Counts, classes and probabilities from the usable rows of ``docs``; a null text is empty."""
    texts = docs.where(usable).select(F.col("text").cast("string").alias("text"))
    n_texts = docs.where(usable).count()
    vocabulary = checkpointed(word_counts(texts))
    # counts up to 4096 as they are, higher ones in steps: the table of steps is bounded
    step = F.when(F.col("n") <= 4096, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double")) * 16) / 16).cast("long"))
    steps = vocabulary.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).orderBy(F.desc("step")).collect()
    held, least = 0, (steps[0]["step"] + 1 if steps else 1)
    for r in steps:
        if held + r["words"] > LEXICON:
            break
        held, least = held + r["words"], r["step"]
    frequent = vocabulary.where(F.col("n") >= least).toArrow()
    frequent = frequent.sort_by([("n", "descending"), ("word", "ascending")])
    lexicon, counts = frequent["word"].combine_chunks(), frequent["n"].to_numpy()
    if isinstance(lexicon, pa.ChunkedArray):
        lexicon = pa.array([], pa.string())
    lexicon = lexicon.cast(pa.string())
    own = min(UNIT_WORDS, len(lexicon))
    first = lexicon[:own].to_pylist()
    ends = (vocabulary.where(~F.col("word").isin(first)) if first else vocabulary).groupBy(
        F.right("word", F.lit(ENDING)).alias("ending")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
    ends = ends.orderBy(F.desc("n"), "ending").limit(UNIT_ENDINGS).collect()
    endings = {r["ending"]: own + i for i, r in enumerate(ends)}
    n = own + len(ends) + 2
    rest = pc.utf8_slice_codeunits(lexicon.slice(own), -ENDING).to_pylist()
    unit_of = np.array([*range(own), *(endings.get(e, n - 2) for e in rest)], np.int64)
    units = Units(lexicon, counts, unit_of, endings, n)
    n_tokens, n_words = sum(r["tokens"] for r in steps), sum(r["words"] for r in steps)
    k = class_number(n_words) + 1
    seed = exchange(bigrams(texts, units), k - 1)

    # from here on every word of the lexicon is a unit
    units, class_of = every_word(units, seed)
    class_of = sweep_words(texts, units, class_of, k)
    units, class_of = by_ending(units, class_of, own)
    found = neighbours(texts, units, class_of, k, None)
    table = _bigrams_of(found, k)
    rare = written(_chosen(found.where("place >= 0"), table, None))
    table += _dense(rare.select("class", F.inline("found")).groupBy((F.col("cell") * k + F.col("class")).alias("cell")).agg(F.sum("n").alias("n")), k)
    rare = rare.select("word", "n", "class")

    in_class, words_of = np.zeros(k), np.zeros(k)
    np.add.at(in_class, class_of[: len(lexicon)], counts)
    np.add.at(words_of, class_of[: len(lexicon)], 1)
    for r in rare.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        in_class[r["class"]] += r["n"]
        words_of[r["class"]] += r["words"]
    in_class[0], words_of[0] = n_texts, n_texts > 0
    spread = np.log10(in_class + 0.5 * (words_of + 1))
    share = (in_class + 1) / (in_class + 1).sum()
    steps_ = np.log10((table + SMOOTHING * share) / (table.sum(axis=1, keepdims=True) + SMOOTHING))
    return Fitted(Model(units, class_of, steps_, spread, n_texts), rare, n_tokens + n_texts, n_words + (n_texts > 0))


def every_word(units: Units, class_of: np.ndarray) -> tuple[Units, np.ndarray]:
    """Units of their own for all words of the lexicon, then for the endings, the rest and the end."""
    own, ends = len(units.lexicon), list(units.endings)
    out = Units(units.lexicon, units.counts, np.arange(own), {e: own + i for i, e in enumerate(ends)}, own + len(ends) + 2)
    last = [units.endings[e] for e in ends] + [units.n - 2, units.n - 1]
    return out, class_of[np.concatenate([units.unit_of, np.array(last, np.int64)])]


def by_ending(units: Units, class_of: np.ndarray, first: int) -> tuple[Units, np.ndarray]:
    """The class of each ending is that of most of its words in the lexicon after the ``first``; of the
    rest, that of most words of all; on a tie, the smaller class. Without such words all stays as it is."""
    own = len(units.lexicon)
    if own <= first:
        return units, class_of
    ends = pc.utf8_slice_codeunits(units.lexicon.slice(first), -ENDING).dictionary_encode()
    names, k = ends.dictionary.to_pylist(), int(class_of.max()) + 1
    votes = np.bincount(ends.indices.to_numpy().astype(np.int64) * k + class_of[first:own], minlength=len(names) * k).reshape(-1, k)
    out = Units(units.lexicon, units.counts, units.unit_of, {e: own + i for i, e in enumerate(names)}, own + len(names) + 2)
    return out, np.concatenate([class_of[:own], votes.argmax(axis=1), [votes.sum(axis=0).argmax(), class_of[-1]]])


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    A text is its words, capitals A-Z made small, and one end; null and empty texts are the end
    alone. Words never met in training count 0 and belong to the class of their ending. Repeated
    rows and null ids each get a row, other columns are ignored, an empty table gives an empty
    result, and without training text all words are unknown. Rows are told apart by their place in
    the scan, which a repeated task meets again; counts of rare words come by a join on the word.
    """
    shared = shipped(docs.sparkSession, fitted.model)
    names = ["rid", "doc_id", "word", "before", "own", "times", "n_tokens", "n_known", "logs", "steps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for b in batches:
            for lo, hi, data, offs in ts.text_slices(b.column(2), SLICE_BYTES):
                rid, ids = b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)
                sums, words, far = model.measure(data, offs)
                none = lambda n, kind=pa.int64(): pa.nulls(n, kind)
                # a text's own row carries a word that no text can hold and that differs from others
                alone = pa.array([f" {r}" for r in rid.to_pylist()], pa.string())
                size = hi - lo
                yield pa.RecordBatch.from_arrays([rid, ids, alone, none(size), none(size), none(size), *(pa.array(sums[c]) for c in names[6:])], names)
                at, size = pa.array(far["row"]), len(words)
                yield pa.RecordBatch.from_arrays([rid.take(at), ids.take(at), words, *(pa.array(far[c]) for c in names[3:6]),
                                                  none(size), none(size), none(size, pa.float64()), none(size, pa.float64())], names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c))
            here = lambda x: pc.fill_null(x, 0).to_numpy(zero_copy_only=False)
            times, n, before = here(get("times")), here(get("n")), here(get("before"))
            own = here(pc.coalesce(get("class").cast(pa.int64()), get("own")))
            out = {"n_tokens": here(get("n_tokens")), "n_known": here(get("n_known")) + times * (n > 0),
                   "logs": here(get("logs")) + times * np.log10(n + 0.5),
                   "steps": here(get("steps")) + times * (model.steps[before, own] - model.spread[own])}
            yield pa.RecordBatch.from_arrays([get("rid"), get("doc_id"), *map(pa.array, out.values())], ["rid", "doc_id", *out])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    parts = rows.mapInArrow(run, f"rid long, doc_id {kind}, word string, before long, own long, times long, n_tokens long, n_known long, logs double, steps double")
    parts = parts.join(fitted.rare, "word", "left").mapInArrow(finish, f"rid long, doc_id {kind}, n_tokens long, n_known long, logs double, steps double")
    sums = parts.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "steps")))
    base = float(np.log10(fitted.tokens + 0.5 * (fitted.words + 1)))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(fitted.tokens).cast("long").alias("train_tokens"),
                       (F.col("logs") - F.col("n_tokens") * base).alias("base_score"), (F.col("logs") + F.col("steps")).alias("score"))
