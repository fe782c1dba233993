"""Token counts of a unigram tokenizer by dynamic programming over a shared trie (operator 7).

The distinct pre-tokens of a slice of text form a trie. The forward step of the best segmentation
into pieces depends on the prefix alone, so it is done once for each trie node; a pre-token's count
is read at its last node. Nodes of one depth are handled at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import shipped

#: Mark that a pre-token begins with, as the vocabulary has it.
MARK = "▁"
#: A byte of a character that is no piece costs this much more than the rarest piece.
BYTE_EXTRA = 10.0
SLICE_BYTES = 4 << 20
_SHIFT = np.int64(21)


def zipf_scores(model_file: str) -> dict[str, float]:
    """Pieces of a sentencepiece file and log scores by Zipf's law from their order.

    The file's BPE pieces come in the order of merges, the frequent first; it holds no
    probabilities, so a piece of rank r scores -ln(r + 2). Control and byte pieces are left out.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {sp.id_to_piece(i): -float(np.log(r + 2)) for r, i in enumerate(ids)}


@dataclass
class Vocabulary:
    """The pieces as a trie: edges (state << 21 | code point) in order, and states' scores."""

    edges: np.ndarray
    to: np.ndarray
    score: np.ndarray
    longest: int
    byte_score: float

    @classmethod
    def of(cls, pieces: dict[str, float]) -> Vocabulary:
        nexts: dict[int, int] = {}
        score = [-np.inf]
        for piece, s in pieces.items():
            state = 0
            for c in piece:
                key = state << 21 | ord(c)
                if key not in nexts:
                    nexts[key] = len(score)
                    score.append(-np.inf)
                state = nexts[key]
            score[state] = s
        order = sorted(nexts)
        return cls(np.array(order, np.int64), np.array([nexts[k] for k in order], np.int32), np.array(score),
                   max(map(len, pieces), default=1), min(pieces.values(), default=0.0) - BYTE_EXTRA)

    def step(self, state: np.ndarray, cp: np.ndarray) -> np.ndarray:
        """States after a character; -1 where no piece goes on, or from -1."""
        out = np.full(len(state), -1, np.int32)
        live = np.flatnonzero(state >= 0)
        if len(self.edges) and len(live):
            key = (state[live].astype(np.int64) << _SHIFT) | cp[live]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            out[live] = np.where(self.edges[at] == key, self.to[at], -1)
        return out

    def counts(self, words: pa.Array) -> np.ndarray:
        """Pieces in the best segmentation of each (distinct) word with MARK before it.

        The best has the highest score; of equal scores, the fewest pieces. A character that is no
        piece becomes one piece for each of its UTF-8 bytes.
        """
        order = pc.sort_indices(words).to_numpy()
        body = words.take(pa.array(order)).cast(pa.large_string())
        data, offs = ts.buffers(body)
        cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        first = ts.char_prefix(data)[offs]
        start, size = first[:-1], np.diff(first)
        out = np.zeros(len(words), np.int64)
        wide = self.longest
        # one node, the mark; column k of a node: state of its last k characters, score and count k characters back
        state = np.full((1, wide + 1), -1, np.int32)
        best = np.full((1, wide + 1), -np.inf)
        count = np.zeros((1, wide + 1), np.int64)
        best[0, 0] = 0.0
        state, best, count = self._level(state, best, count, np.array([ord(MARK)]))
        word, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        depth = 0
        out[order] = count[0, 0]  # for empty words
        while True:
            go = size[word] > depth
            word, node = word[go], node[go]
            if not len(word):
                return out
            cp = cps[start[word] + depth]
            new = np.ones(len(word), bool)
            new[1:] = (node[1:] != node[:-1]) | (cp[1:] != cp[:-1])
            parent = node[new]
            state, best, count = self._level(state[parent], best[parent], count[parent], cp[new])
            node = np.cumsum(new) - 1
            depth += 1
            last = size[word] == depth
            out[order[word[last]]] = count[node[last], 0]

    def _level(self, state: np.ndarray, best: np.ndarray, count: np.ndarray, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One character further for each node, given its parent's columns."""
        n, wide = len(cp), self.longest
        s, b, c = (np.empty((n, wide + 1), x.dtype) for x in (state, best, count))
        b[:, 1:], c[:, 1:] = best[:, :-1], count[:, :-1]
        s[:, 0] = -1
        s[:, 1] = self.step(np.zeros(n, np.int32), cp)
        s[:, 2:] = self.step(state[:, 1:-1].ravel(), np.repeat(cp, wide - 1)).reshape(n, wide - 1)
        value = np.where(s >= 0, self.score[np.maximum(s, 0)], -np.inf)
        alone = value[:, 1] == -np.inf
        n_bytes = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
        value[alone, 1] = self.byte_score * n_bytes[alone]
        total = b + value
        total[:, 0] = -np.inf
        pieces = c + 1
        pieces[:, 1] += np.where(alone, n_bytes - 1, 0)
        top = total.max(axis=1)
        b[:, 0] = top
        c[:, 0] = np.where(total == top[:, None], pieces, np.iinfo(np.int64).max).min(axis=1)
        return s, b, c


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_words, n_tokens of every row of ``docs``.

    Null and empty texts have none. Words are runs of characters other than ASCII white space. Rows
    are judged one by one: repeated rows and null ids are kept, other columns are ignored, an empty
    table gives an empty result. A very long word takes one step for each character.
    """
    shared = shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared()
        for b in batches:
            for lo, hi, data, offs in ts.text_slices(b.column(1), SLICE_BYTES):
                start, end, row = ts.word_spans(data, offs)
                coded = ts.words_array(data, start, end).dictionary_encode()
                sizes = pieces.counts(coded.dictionary)[coded.indices.to_numpy()] if len(start) else np.zeros(0)
                n = np.bincount(row, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(np.bincount(row, sizes, hi - lo).astype(np.int64))],
                                                 ["doc_id", "n_words", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
