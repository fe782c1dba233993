"""Language identification by cross-parsing entropy (operator 10).

For each language a suffix automaton of labelled text accepts exactly the substrings of that text.
A document is cut, left to right, into the longest phrases the automaton accepts; the language
that needs the fewest bits of phrases for each letter wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import checkpointed, give_back, hash_share, shipped

#: Most letters and spaces of labelled text that an automaton is built from, for each language.
TRAIN_SYMBOLS = 30_000
#: Letters with a symbol of their own, the most frequent ones; the other letters of the labelled text
#: are written as numbers to the base DIGITS, so that each differs from all others in any script.
ALPHABET, DIGITS = 62, 32
#: Symbols parsed in one go: a phrase ends at such a border, for every language alike.
SEGMENT = 512
UNKNOWN = "und"
#: Letters in no labelled text.
OTHER_LETTER = 1


def letters(text: str) -> str:
    """Small letters, each run of anything else one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def letter_codes(alphabet: str) -> tuple[dict[str, tuple[int, ...]], int]:
    """Symbols of each letter of the alphabet, frequent letters first, and how many symbols there are."""
    own, rare = alphabet[:ALPHABET], alphabet[ALPHABET:]
    first, places = 2 + len(own), 1
    while DIGITS**places < len(rare):
        places += 1
    codes = {c: (i + 2,) for i, c in enumerate(own)}
    codes |= {c: tuple(first + i // DIGITS**k % DIGITS for k in reversed(range(places))) for i, c in enumerate(rare)}
    return codes, first + (DIGITS if rare else 0)


def symbol_table(codes: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Symbols of each code point, a row for each place: first 0 for what is no letter, 2 and up for
    the alphabet's; further places 0 where the letter has fewer symbols."""
    out = np.zeros((max(map(len, codes.values()), default=1), 0x110000), np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            code = codes.get(c.lower()[:1], (OTHER_LETTER,))
            out[: len(code), cp] = code
    return out


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Suffix automaton as a table of next states; -1 where no substring goes on. State 0 starts."""
    follow: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = cur
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(follow), width), -1, np.int32)
    for s, nexts in enumerate(follow):
        for c, t in nexts.items():
            table[s, c] = t
    return table


class Model:
    """The automata of all languages in one table of transitions.

    An entry t >= 0 is the place of the next state's row; an entry below 0 ends a phrase, and ~t
    is where the next phrase goes on after the symbol that began it.
    """

    def __init__(self, samples: dict[str, list[int]], alphabet: str):
        self.langs = sorted(samples)
        codes, self.width = letter_codes(alphabet)
        self.symbols = symbol_table(codes)
        tables, roots, base = [], [], 0
        for lang in self.langs:
            t = automaton(samples[lang], self.width)
            restart = np.maximum(t[0], 0)
            t = np.where(t >= 0, (t + base) * self.width, ~((restart + base) * self.width))
            tables.append(t.ravel().astype(np.int32))
            roots.append(base * self.width)
            base += len(t)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)
        #: Bits that name one phrase: a place in the labelled text.
        self.bits = np.array([math.log2(len(samples[x]) + 1) for x in self.langs])

    def symbolise(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all rows, runs of non-letters kept as one 0, and the rows' offsets."""
        cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        bounds = ts.char_prefix(data)[offs]
        sym = self.symbols[0, cps]
        keep = sym != 0
        keep[1:] |= sym[:-1] != 0
        firsts = bounds[:-1][bounds[:-1] < len(sym)]
        keep[firsts] = sym[firsts] != 0  # a row does not begin with a space
        at = np.concatenate([[0], np.cumsum(keep)])
        sym, bounds = sym[keep], at[bounds]
        if len(self.symbols) > 1:
            places = np.concatenate([sym[None], self.symbols[1:, cps[keep]]]).T
            held = places != 0
            held[:, 0] = True
            sym, bounds = places[held], np.concatenate([[0], np.cumsum(held.sum(axis=1))])[bounds]
        return sym, bounds

    def phrases(self, sym: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Phrases that each language needs for each row: an array of languages by rows."""
        rows, n = len(offs) - 1, np.diff(offs)
        parts = -(-n // SEGMENT)
        row = np.repeat(np.arange(rows), parts)
        start = offs[row] + (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        size = np.minimum(SEGMENT, offs[row + 1] - start)
        order = np.argsort(-size, kind="stable")
        row, start, size = row[order], start[order], size[order]
        cells = np.zeros((SEGMENT, len(row)), np.uint8)
        for k in range(0, len(row), 4096):  # the symbols of each segment as a column
            at = start[k : k + 4096][None, :] + np.arange(SEGMENT)[:, None]
            cells[:, k : k + 4096] = sym[np.minimum(at, len(sym) - 1)]
        active = np.searchsorted(-size, -np.arange(SEGMENT), side="left")  # segments longer than i
        out = np.zeros((len(self.langs), rows))
        for k, root in enumerate(self.roots):
            state = np.full(len(row), root, np.int32)
            count = np.ones(len(row), np.int32)
            for i in range(SEGMENT):
                m = active[i]
                if not m:
                    break
                to = self.table[state[:m] + cells[i, :m]]
                ended = to >> 31
                count[:m] -= ended
                state[:m] = to ^ ended
            out[k] = np.bincount(row, count, rows)
        return out

    def letters_in(self, sym: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Symbols of letters in each row."""
        return np.diff(np.concatenate([[0], np.cumsum(sym != 0)])[bounds])

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        sym, bounds = self.symbolise(data, offs)
        rows = len(offs) - 1
        found = self.letters_in(sym, bounds) > 0
        if not self.langs or not len(sym):
            return [UNKNOWN] * rows, np.zeros(rows)
        bits = self.phrases(sym, bounds) * self.bits[:, None]
        best = bits.argmin(axis=0)
        if len(self.langs) > 1:
            two = np.partition(bits, 1, axis=0)[:2]
            margin = 1 - two[0] / np.maximum(two[1], 1e-9)
        else:
            margin = np.ones(rows)
        names = [self.langs[b] if f else UNKNOWN for b, f in zip(best.tolist(), found.tolist(), strict=True)]
        return names, np.where(found, margin, 0.0)


def fit(docs: DataFrame, usable: Column, max_symbols: int = TRAIN_SYMBOLS) -> Model:
    """Automata from the labelled rows of ``docs`` that are ``usable``.

    For each language rows are taken at a rate that yields about twice ``max_symbols`` characters,
    in the order of a hash of the id, until ``max_symbols`` letters and spaces are there, at most a
    sixteenth of them from one text, a stretch that begins anywhere in it. All their letters are told
    apart, however many; scoring reads every text whole. Languages with no letter in their rows are
    left out.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        hash_share(F.lit("langid"), F.col("doc_id")).alias("h"))
    rates = (rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"))
             # at least about 32 rows, so that one long text does not stand for a language
             .select("lang", F.greatest(2.0 * max_symbols / F.greatest("chars", F.lit(1)), 32.0 / F.col("n")).alias("rate")))
    rates = checkpointed(rates)  # one row for each language; texts are not shuffled to meet them
    rates = F.broadcast(rates) if rates.count() <= 10_000 else rates
    sample = rows.join(rates, "lang").where("h < rate").groupBy("lang").applyInPandas(
        _sampler(max_symbols), "lang string, sample string").toPandas()
    samples = {r.lang: r.sample for r in sample.itertuples() if r.sample.strip()}
    seen: dict[str, int] = {}
    for s in samples.values():
        for c in s.replace(" ", ""):
            seen[c] = seen.get(c, 0) + 1
    alphabet = "".join(sorted(seen, key=lambda c: (-seen[c], c)))
    codes = letter_codes(alphabet)[0] | {" ": (0,)}
    return Model({k: [x for c in v for x in codes[c]] for k, v in samples.items()}, alphabet)


def _sampler(max_symbols: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, size = [], 0
        share = max_symbols // 16  # of one text
        for h, text in rows.sort_values(["h", "text"])[["h", "text"]].itertuples(index=False):
            text, room = letters(text), min(share, max_symbols - size)
            at = int(h * 65536 % 1 * (max(0, len(text) - room) + 1))  # by the low digits, as the order takes the high ones
            out.append(text[at : at + room])
            size += len(out[-1]) + 1
            if size >= max_symbols:
                break
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "sample": [" ".join(out)]})

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs``.

    ``score`` is the share of bits that the best language saves against the second. A text that is
    null, empty or without a letter is ``und`` with score 0, and so is every text if nothing was
    learnt. Ties go to the smallest language by code point. Rows are judged one by one: repeated
    rows and null ids are kept, other columns are ignored, an empty table gives an empty result.
    """
    shared = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shared()
        for b in batches:
            for lo, hi, data, offs in ts.text_slices(b.column(1)):
                names, score = learnt.predict(data, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
        del learnt
        give_back()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` in which a language is found, all columns unchanged.

    If the model has learnt no language, a text with a letter passes: nothing tells against it.
    """
    shared = shipped(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shared()
        for b in batches:
            if b.num_rows:
                slices = ts.text_slices(b.column(at))
                if learnt.langs:
                    kept = [n != UNKNOWN for _, _, data, offs in slices for n in learnt.predict(data, offs)[0]]
                else:
                    kept = [n > 0 for _, _, data, offs in slices for n in learnt.letters_in(*learnt.symbolise(data, offs)).tolist()]
                yield b.filter(pa.array(kept, pa.bool_()))
        del learnt
        give_back()

    return docs.mapInArrow(run, docs.schema)
