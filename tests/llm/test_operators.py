"""Each operator against a plain version, on odd rows, and on no rows."""

import collections
import math
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import (class_lm, components, langid, licenses, mixing, near_dups, packing, quality_model,
                            quality_rules, token_counts, vector_dups)
from marketlens.llm import queries as Q
from marketlens.llm import textscan as ts

from . import plain

SMALL, MIDDLE, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def odd(spark):
    return plain.odd_docs(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return plain.odd_docs(spark, [])


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- 1 mixing

def test_mixing_odd_rows(odd, none):
    got = mixing.taken(odd).collect()
    assert len(got) == odd.count()
    by_source = collections.defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_source[r.source] += r.taken
    for r in got:
        assert by_source[r.source] == math.floor(r.target) and r.target <= 2 * r.source_size
    total = sum(r.size for r in got)
    assert abs(sum(by_source.values()) - 1.5 * total) <= len(by_source)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(odd.repartition(7)).collect()))
    assert mixing.taken(none).collect() == [] and mixing.mixed(none).collect() == []
    assert mixing.mixed(odd).columns == odd.columns


def test_mixing_targets_refill(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 1000, 1), (None, 0, 1)], "source string, source_size long, n long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # a stops at 20; the rest of 3015 goes to b and c as 1 : 2, and c stays below 2000
    assert got == pytest.approx({"a": 20.0, "b": 2995 / 3, "c": 2 * 2995 / 3, None: 0.0})


def test_schedule_meets_every_block_and_stays_even(spark):
    blocks = {1: 700, 2: 250, 3: 50}
    per = spark.createDataFrame([(k, v * 16) for k, v in blocks.items()], "ix int, quota long")
    got = sorted(mixing.schedule(per, 1000, 16).collect())
    for ix, n in blocks.items():
        assert [r.block for r in got if r.ix == ix] == list(range(n))
    head = collections.Counter(r.ix for r in got[:200])
    assert all(abs(head[k] - 0.2 * n) <= 8 for k, n in blocks.items())


def test_mixed_documents_repeat_by_passes(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "en", "s", 100) for i in range(40)] + [(99, "w " * 50, "en", "t", 100)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r.doc_id: r.taken for r in mixing.taken(docs).collect()}
    times = collections.Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert times == {i: math.ceil(n / 50) for i, n in taken.items() if n}


# --- 2 quality rules

def test_quality_rules_base_columns(spark, small, odd, none):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in quality_rules.score(docs).select(cols).collect()}
    for i, text in small:
        assert got[i][:6] == plain.base_rules(text)
    odd_text = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    odd_got = quality_rules.score(odd).select(cols).collect()
    assert len(odd_got) == odd.count()
    for r in odd_got:
        if r.doc_id is not None:
            assert tuple(r)[1:7] == plain.base_rules(odd_text[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert quality_rules.score(none).collect() == []
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in odd_got)


def test_quality_rules_coverage(spark):
    block = " ".join(f"a{i}" for i in range(40))
    fresh = " ".join(f"b{i}" for i in range(200))
    got = quality_rules.measure(*ts.buffers(pa.array([block + "\n" + fresh + "\n" + block, fresh])))
    twice = 2 * sum(len(w) for w in block.split())
    assert got["covered_5"][0] == pytest.approx(twice / got["word_chars"][0]) and got["covered_5"][1] == 0
    assert got["dup_line_share"][0] == pytest.approx(twice / 2 / got["word_chars"][0])
    assert got["kept"].tolist() == [True, True]
    assert not quality_rules.measure(*ts.buffers(pa.array(["\n".join([block] * 5)])))["kept"][0]


# --- 3 quality classifier

def test_quality_model_held_out(spark):
    got = Q.op3(spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in got])
    caught = np.mean([r.predicted == 0 for r in got if r.quality == 0])
    assert right > 0.97 and caught > 0.85 and all(0 <= r.score <= 1 for r in got)


def test_quality_model_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (7, 0), (6, 0), (None, 1), (8, 5), (13, 1)], "doc_id long, quality int")
    model = quality_model.fit(odd, labels, F.lit(True))
    got = quality_model.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality_model.score(none, quality_model.fit(none, labels, F.lit(True))).collect() == []


def test_boosting_learns_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.boost(x, y)
    assert (1, 0) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


# --- 4 class n-grams

@pytest.mark.parametrize("lexicon", [250_000, 500])
def test_class_lm_base_score(spark, small, lexicon, monkeypatch):
    monkeypatch.setattr(class_lm, "LEXICON", lexicon)
    got = {r.doc_id: r for r in Q.op4(spark, SMALL).collect()}
    counts, texts = collections.Counter(), 0
    split = {i: plain.words((t or "").translate(plain.SMALL)) for i, t in small}
    for i, w in split.items():
        if plain.fold(i) != 1:
            counts.update(w)
            texts += 1
    n, v = sum(counts.values()) + texts, len(counts) + 1
    log = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    base = model = 0.0
    for i, w in split.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w) + 1, 1 + sum(counts[x] > 0 for x in w), n, plain.fold(i) == 1)
        assert r.base_score == pytest.approx(sum(log(counts[x]) for x in w) + log(texts), rel=1e-9)
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > base


def test_class_lm_is_a_distribution(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "b c d", "a a b", "d e f a"])], "doc_id long, text string")
    fitted = class_lm.fit(docs, F.lit(True))
    m = fitted.model
    assert np.allclose((10**m.steps).sum(axis=1), 1)
    words = pa.array(sorted({w for r in docs.collect() for w in r.text.split()}))
    at, unit = m.units.lookup(words)
    emission = (m.units.counts[at] + 0.5) / 10 ** m.spread[m.class_of[unit]]
    for c in set(m.class_of[unit].tolist()):
        unseen = 0.5 / 10 ** m.spread[c]
        assert emission[m.class_of[unit] == c].sum() + unseen == pytest.approx(1)


def likelihood(pairs, of, k):
    hot = np.eye(k)[of]
    table = hot.T @ pairs @ hot
    f = class_lm._xlogx
    return f(table).sum() - f(table.sum(axis=0)).sum() - f(table.sum(axis=1)).sum()


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(3)
    pairs = rng.poisson(3, (25, 25)).astype(float)
    of = class_lm.exchange(pairs, classes=4, sweeps=100)
    best = max(likelihood(pairs, np.where(np.arange(25) == u, c, of), 5) for u in range(24) for c in range(1, 5))
    assert best <= likelihood(pairs, of, 5) + 1e-6 and of[24] == 0 and (of[:24] > 0).all()


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(1)
    truth = np.arange(40) % 4
    pairs = np.zeros((41, 41))
    pairs[:40, :40] = rng.poisson(np.where((truth[:, None] + 1) % 4 == truth[None, :], 50, 1))
    of = class_lm.exchange(pairs, classes=4)
    assert len({(a, b) for a, b in zip(of[:40].tolist(), truth.tolist(), strict=True)}) == 4


@pytest.mark.parametrize("counted", [True, False])
def test_best_class_is_the_likeliest(counted, monkeypatch):
    """Against the likelihood of the whole table, for words that do not follow themselves."""
    monkeypatch.setattr(class_lm, "CELLS", 30)
    rng, k, words = np.random.default_rng(5), 5, 12
    pairs = rng.poisson(1.5, (words + 1, words + 1)).astype(float)
    np.fill_diagonal(pairs, 0)
    of = np.append(rng.integers(1, k, words), 0)
    hot = np.eye(k)[of]
    table = hot.T @ pairs @ hot
    before, after = (pairs.T @ hot)[:words], (pairs @ hot)[:words]
    if not counted:  # judged on classes before them alone, like words outside the lexicon
        after[:] = 0
    found = [np.flatnonzero(np.concatenate([b, a])) for b, a in zip(before, after, strict=True)]
    starts = np.append(0, np.cumsum([len(f) for f in found]))
    n = np.concatenate([np.concatenate([b, a])[f] for f, b, a in zip(found, before, after, strict=True)]).astype(np.int64)
    got = class_lm.best_classes(table, starts, np.concatenate(found), n, of[:words] if counted else None)
    for w in range(words):
        def moved(c, w=w):
            t = table.copy()
            if counted:
                t[:, of[w]] -= before[w]
                t[of[w]] -= after[w]
            t[:, c] += before[w]
            t[c] += after[w]
            return class_lm.log_likelihood(t)
        scores = [moved(c) for c in range(1, k)]
        rows = table.sum(axis=1) + (0 if counted else before[w])  # rows of classes before do not depend on the choice
        assert rows.min() >= 0 and scores[got[w] - 1] == pytest.approx(max(scores), abs=1e-9)


@pytest.mark.parametrize("counted", [True, False])
def test_class_choice_computes_equal_counts_once(counted, monkeypatch):
    """The logarithms follow the different counts, not the words; all words alike get one class."""
    k, words, done, plain_log = 20, 3000, [], class_lm._xlogx
    table = np.random.default_rng(7).poisson(50, (k, k)).astype(float)
    cell, n = np.tile([3, 7, k + 2, k + 9] if counted else [3, 7, 8, 9], words), np.tile([1, 2, 1, 2], words)

    def counting(x):
        done.append(np.size(x))
        return plain_log(x)

    monkeypatch.setattr(class_lm, "_xlogx", counting)
    got = class_lm.best_classes(table, np.arange(0, 4 * words + 1, 4), cell, n, np.full(words, 5) if counted else None)
    assert len(set(got.tolist())) == 1 and got[0] > 0
    assert sum(done) < words * k


def test_rows_added_up_by_word():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 9, 50)
    first, rows = np.cumsum(sizes) - sizes, rng.integers(0, 100, (30, 4)).astype(float)
    at = rng.integers(0, 30, sizes.sum())
    assert (class_lm._summed(rows, at, first, sizes) == np.add.reduceat(rows[at], first, axis=0)).all()


@pytest.mark.parametrize("endings", [{}, {"x": 2, "\u00e9x": 4, "\u672c\u8a9e": 3}])
def test_units_of_words(endings):
    units = class_lm.Units(pa.array(["a", "pq"]), np.array([3, 2]), np.arange(2), endings, 7)
    words = ["a", "z\u00e9x", "x", "yx", "\u65e5\u672c\u8a9e", "pq", "z\u00e9x", "\U0001f600"]
    at, unit = units.lookup(pa.array(words, pa.string()))
    assert at.tolist() == [{"a": 0, "pq": 1}.get(w, -1) for w in words]
    assert unit.tolist() == [{"a": 0, "pq": 1}.get(w, endings.get(w[-2:], 5)) for w in words]
    assert [x.tolist() for x in units.lookup(pa.array([], pa.string()))] == [[], []]


def test_class_lm_counts_beside_words(spark):
    """Counts of classes and classes of rare words against plain Python, with a lexicon that holds half of the words."""
    texts = ["a b a c x", "b c y d", "a a b x", "d e f a y z", ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    units = class_lm.Units(pa.array(list("abcd")), np.array([6, 3, 2, 2]), np.arange(4), {"x": 4}, 7)  # places, ending x, rest, end
    of, k = np.array([1, 2, 1, 2, 2, 1, 0]), 3
    name = lambda w: "abcd".find(w) if w in "abcd" else 4 if w == "x" else 5
    want, table, rare, inside = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    stream = [(None, 6)]
    for t in texts:
        stream += [*((w, name(w)) for w in t.split()), (None, 6)]
    # the end before a text is the end of the text before it
    for (v, p), (w, q) in zip(stream, stream[1:], strict=False):
        table[of[p] * k + of[q]] += 1
        if p < 4:
            want[p, k + of[q]] += 1
        if q < 4:
            want[q, of[p]] += 1
        if q in (4, 5):
            rare[w, of[p]] += 1
        else:
            inside[of[p] * k + of[q]] += 1
    for i in range(2):
        got = class_lm.neighbours(docs, units, of, k, (i, 2)).collect()
        assert {(r.place, f.cell): f.n for r in got if r.place >= 0 for f in r.found} == {c: n for c, n in want.items() if c[0] % 2 == i}
        assert {f.cell: f.n for r in got if r.place < 0 for f in r.found} == table
    got = class_lm.neighbours(docs, units, of, k, None).collect()
    assert {(r.word, f.cell): f.n for r in got if r.word for f in r.found} == rare
    assert {f.cell: f.n for r in got if r.place < 0 for f in r.found} == inside


def test_class_lm_sweeps_raise_the_likelihood(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text")
    counts = class_lm.word_counts(docs).orderBy(F.desc("n"), "word").toArrow()
    n = len(counts)
    units = class_lm.Units(counts["word"].combine_chunks().cast(pa.string()), counts["n"].to_numpy(), np.arange(n), {}, n + 2)
    first = np.append(1 + np.arange(n + 1) % 8, 0)
    value = lambda of: class_lm.log_likelihood(class_lm._bigrams_of(class_lm.neighbours(docs, units, of, 9, (0, 2)), 9))
    of = class_lm.sweep_words(docs, units, first, 9, sweeps=2)
    assert value(of) > value(first) and of[-1] == 0 and (of[:-1] > 0).all()


def test_classes_grow_with_the_vocabulary():
    assert class_lm.class_number(0) == class_lm.LEAST_CLASSES
    assert class_lm.class_number(8_000_000) == 4 * class_lm.class_number(125_000)


def test_class_lm_odd_rows(odd, none):
    fitted = class_lm.fit(odd, F.lit(True))
    got = class_lm.score(odd, fitted).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert class_lm.score(none, fitted).collect() == []
    untrained = class_lm.score(odd, class_lm.fit(none, F.lit(True))).collect()
    assert len(untrained) == odd.count() and all(r.n_known == 0 and r.train_tokens == 0 for r in untrained)


# --- 5 licences

def test_license_scan(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    scanner = licenses.fit(docs)
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in licenses.scan(docs, scanner).collect()}
    known = {n: f for f, texts in licenses.NOTICES.items() for n in texts}
    expected = {(r.doc_id, k): (known[line], True) for r in docs.collect() for k, line in enumerate((r.text or "").split("\n")) if line in known}
    assert len(expected) > 20 and expected.items() <= got.items()
    assert not [k for k, (_, sure) in got.items() if sure and k not in expected]
    odd = plain.odd_docs(spark)
    assert [r for r in licenses.scan(odd, scanner).collect() if r.confirmed] == []
    assert licenses.scan(plain.odd_docs(spark, []), scanner).collect() == []


# --- 6 packing

def test_license_training_wraps_every_notice(spark):
    drawn = spark.range(4000).select(F.col("id").cast("string").alias("text"), F.xxhash64("id").alias("h"))
    count = sum(map(len, licenses.NOTICES.values()))
    got = {r.number for r in licenses._around(drawn, 8 * count).select("number").distinct().collect()}
    assert set(range(count)) <= got


def check_packed(rows, texts, end=packing.END):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path(Q.TOKENIZER))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, end] for i, t in texts}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, parts in by_doc.items():
        assert sum(n for _, n in parts) % len(ids[i]) == 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    return by_sequence


def test_packing_round_trip(spark, small):
    rows = Q.op6(spark, SMALL).collect()
    sequences = check_packed(rows, small)
    assert {r.doc_id for r in rows} == {i for i, _ in small}
    tokens = sum(r.length for r in rows)
    assert len(sequences) <= tokens / packing.SIZE * 1.02 + 1


def test_packing_odd_rows(odd, none):
    rows = packing.pack(odd, Q.tokenizer_path(Q.TOKENIZER)).collect()
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 4 for r in rows) == 2
    texts = dict((r.doc_id, r.text) for r in odd.collect())
    by_sequence = collections.defaultdict(int)
    for r in rows:
        by_sequence[r.sequence_id] += r.length
        if not texts[r.doc_id] and r.doc_id is not None:
            assert (r.start, r.length, r.doc_tokens) == (0, 1, 1)
    assert max(by_sequence.values()) <= packing.SIZE
    assert packing.pack(none, Q.tokenizer_path(Q.TOKENIZER)).collect() == []
    with_ids = packing.pack(odd, Q.tokenizer_path(Q.TOKENIZER), with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in with_ids)


def test_patterns_use_every_piece():
    rng = random.Random(3)
    counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, 2049), 400)}
    found = packing.patterns(counts)
    used = collections.Counter()
    for times, lengths in found:
        assert sum(lengths) <= packing.SIZE
        for n in lengths:
            used[n] += times
    assert used == counts


# --- 7 token counts

def test_token_counts_against_plain_search(spark, small):
    pieces = token_counts.zipf_scores(Q.tokenizer_path(Q.PIECES))
    vocabulary = token_counts.Vocabulary.of(pieces)

    def count(word):
        best = [(0.0, 0)]
        word = token_counts.MARK + word
        for i in range(1, len(word) + 1):
            options = [(best[j][0] + pieces[word[j:i]], -best[j][1] - 1) for j in range(max(0, i - vocabulary.longest), i) if word[j:i] in pieces]
            if word[i - 1] not in pieces:
                n = len(word[i - 1].encode())
                options.append((best[i - 1][0] + n * vocabulary.byte_score, -best[i - 1][1] - n))
            score, n = max(options)
            best.append((score, -n))
        return best[-1][1]

    known = {}
    got = {r.doc_id: r for r in Q.op7(spark, SMALL).collect()}
    for i, text in small[:60]:
        w = plain.words(text)
        assert got[i].n_words == len(w)
        assert got[i].n_tokens == sum(known.setdefault(x, count(x)) for x in w)


def test_token_counts_odd_rows(odd, none):
    vocabulary = token_counts.Vocabulary.of({"▁": -1.0, "▁one": -2.0, "x": -1.5, "xx": -1.6})
    got = token_counts.count_tokens(odd, vocabulary).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    assert (by_id[1].n_tokens, by_id[3].n_words, by_id[6].n_tokens) == (0, 0, 1 + 25_000)
    assert token_counts.count_tokens(none, vocabulary).collect() == []


# --- 8 embedding near-duplicates

def plain_vectors(rows):
    groups, links = plain.Groups(), collections.Counter()
    for k, (i, v, lab) in enumerate(rows):
        groups.find(i)
        for j, u, other in rows[:k]:
            if lab is not None and lab == other and len(u) == len(v):
                a, b = np.array(u, float), np.array(v, float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    groups.join(i, j)
    return {i: (links[i], groups.find(i)) for i, _, _ in rows}


def test_vector_dups_recall_of_planted_neighbours(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((8000, 32))
    for k in range(0, 4000, 2):  # pairs and chains around the threshold
        away = rng.standard_normal(32)
        unit = x[k] / np.linalg.norm(x[k])
        away -= (away @ unit) * unit
        cos = rng.uniform(0.9, 0.98)
        x[k + 1] = (cos * unit + np.sqrt(1 - cos**2) * away / np.linalg.norm(away)) * rng.uniform(0.5, 3)
    label = np.arange(8000) // 4 % 3
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    groups = plain.Groups()
    for i, j in zip(*np.nonzero(near), strict=True):
        groups.join(int(i), int(j))
    expected = {i: (int(near[i].sum()) - 1, groups.find(i)) for i in range(8000)}
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(8000), "embedding": list(x), "label": label}), "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dups.near_duplicates(df.repartition(5)).collect()}
    assert sum(n for n, _ in expected.values()) > 1500 and got == {i: (n, c, i == c) for i, (n, c) in expected.items()}


def test_vector_dups_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 8))
    rows = [(i, (base[i % 6] + 0.02 * rng.standard_normal(8)).tolist(), i % 2) for i in range(60)]
    rows += [(100 + i, base[0].tolist(), 0) for i in range(40)]  # copies
    odd = [(200, None, 0), (201, [0.0] * 8, 0), (202, [], 0), (203, [float("nan")] + [1.0] * 7, 0), (204, [None] + [1.0] * 7, 0),
           (205, base[0].tolist(), None), (None, base[0].tolist(), None), (206, [float("inf")] * 8, 0), (207, [1.0, 2.0], 0), (208, [2.0, 4.0], 0), (209, [1.0], 0)]
    extra = "vec_id long, embedding array<double>, label int, n long, root long, rid long, id long, cell int, print1 long, copies string"
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, 1, 1, "z") for r in rows + odd], extra)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dups.near_duplicates(df).collect()}
    expected = plain_vectors(rows + [r for r in odd if r[0] in (207, 208, 209)])
    for i, (n, c) in expected.items():
        assert got[i] == (n, c, i == c)
    assert all(got[i] == (0, i, True) for i in (200, 201, 202, 203, 204, 205, 206)) and got[None] == (0, None, True)
    assert vector_dups.near_duplicates(spark.createDataFrame([], extra)).collect() == []


def test_multi_sequence_order_is_by_distance():
    rng = np.random.default_rng(2)
    x = vector_dups.unit(rng.standard_normal((500, 16)))
    index = vector_dups.fit(x, 6)
    order = index.order(x, index.cells())
    d = (vector_dups._distances(x[:, :8], index.first)[:, :, None] + vector_dups._distances(x[:, 8:], index.second)[:, None, :]).reshape(500, -1)
    along = np.take_along_axis(d, order, 1)
    assert (np.diff(along, axis=1) >= -1e-12).all()
    few = index.order(x, 7)
    assert np.allclose(np.take_along_axis(d, few, 1), along[:, :7])


# --- 9 near-duplicates

def test_near_dups_against_all_pairs(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    expected = plain.near_duplicates([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs).collect()}
    assert got == expected and len({c for _, c in expected.values()}) < len(expected) - 30


def hot_documents():
    """A passage in most documents, a large group of near copies, chains, exact copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage, text = [word() for _ in range(60)], [word() for _ in range(120)]
    rows = []
    for i in range(250):
        rows.append([word() for _ in range(rng.randint(20, 150))] + passage)
    for _ in range(200):
        t = list(text)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = word()
        rows.append(t)
    chain = [word() for _ in range(100)]
    for k in range(20):  # each step differs by a tenth from the one before
        chain = list(chain)
        chain[(k * 7) % 90 : (k * 7) % 90 + 6] = [word() for _ in range(6)]
        rows.append(chain)
    rows += [list(text) for _ in range(60)]
    for n in (1, 2, 3, 4, 5, 6):
        rows += [text[:n], text[:n]]
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_near_dups_hot_groups(spark):
    rows = hot_documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(df).collect()}
    assert got == plain.near_duplicates(rows)


def test_near_dups_in_long_lists_only(spark):
    """Groups of over 24 texts that link through one alone, at exactly 0.75."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(2):  # short: three shingles inside four
        base = " ".join(word() for _ in range(7))
        rows += [base, *[f"{base} {word()}" for _ in range(40)]]
    # long: 300 shingles inside 400, and 60 such texts that share 0.6 with each other
    for _ in range(2):
        base = [word() for _ in range(304)]
        rows += [" ".join(base), *[" ".join(base + [word() for _ in range(100)]) for _ in range(60)]]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    expected = plain.near_duplicates(rows)
    assert len({c for _, c in expected.values()}) == 4
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(df).collect()} == expected


def test_near_dups_loses_no_short_pair(spark):
    """100,000 pairs of texts of 7 and 8 words, at exactly 0.75."""
    rng = np.random.default_rng(29)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghij"), (100_000, 8, 6)).reshape(-1, 6)]).reshape(-1, 8)
    rows = [(2 * i + k, " ".join(w[: 7 + k])) for i, w in enumerate(words.tolist()) for k in (0, 1)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"])).repartition(4)
    got = near_dups.near_duplicates(df)
    assert got.where("component_id <> doc_id - doc_id % 2 or n_shingles <> 3 + doc_id % 2").count() == 0 and got.count() == len(rows)


def test_near_dups_lists_guarantee_a_meeting():
    """Any two sketches that share enough have a list in common, whatever the counts."""
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 4, 7, 40, 70, 71, 95, 96):
        need = int(near_dups.needed(np.array([n]))[0])
        assert need <= n and (n > 70 or need == math.ceil(0.75 * n))
        for _ in range(50):
            pool = rng.permutation(5000)[: 2 * n - need].astype(np.uint64)
            sets = [np.sort(pool[:n]), np.sort(pool[n - need :])]
            counts = rng.integers(0, 9, near_dups.COUNTERS)
            keys, at = near_dups.rarest(np.concatenate(sets), np.array([0, n, 2 * n]), counts)
            assert np.intersect1d(keys[: at[1]], keys[at[1] :]).size


def test_near_dups_odd_rows(odd, none):
    got = near_dups.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].component_id for i in (1, 2, 3, 4, 5, 13, 8, 9, 15)] == [1, 2, 3, 4, 4, 4, 8, 8, 4]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_dups.near_duplicates(none).collect() == []
    left = near_dups.one_of_each(odd)
    assert left.columns == odd.columns
    # a row that repeats an id and its text goes, one with a null id stays
    ids = collections.Counter(r.doc_id for r in left.collect())
    assert ids == {i: 1 for i in {r.doc_id for r in got if r.kept and r.doc_id is not None}} | {None: sum(r.doc_id is None for r in got)}


def test_components_against_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, None), (2000, 2000)]
    groups = plain.Groups()
    for a, b in links:
        if b is not None:
            groups.join(a, b)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: groups.find(i) for a, b in links if b is not None for i in (a, b)}


# --- 10 language ID

def test_automaton_knows_exactly_the_substrings():
    text = [1, 2, 1, 2, 2, 1, 3, 1, 2]
    table = langid.automaton(text, 4)
    inside = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
    for n in range(1, 5):
        for k in range(4**n):
            s = tuple(k // 4**i % 4 for i in range(n))
            state = 0
            for c in s:
                state = table[state, c] if state >= 0 else -1
            assert (state >= 0) == (s in inside)


def test_phrases_are_longest_matches():
    rng = random.Random(9)
    sample = {k: [rng.choice([0, 2, 3, 4]) for _ in range(200)] for k in ("x", "y")}
    model = langid.Model(sample, "abc")
    for _ in range(20):
        text = [rng.choice([0, 2, 3, 4]) for _ in range(rng.randint(1, 300))]
        got = model.phrases(np.array(text, np.uint8), np.array([0, len(text)]))
        for lang, n in zip(model.langs, got[:, 0], strict=True):
            have = "".join(map(str, sample[lang]))
            s, at, count = "".join(map(str, text)), 0, 0
            while at < len(s):
                size = 1
                while at + size < len(s) and s[at : at + size + 1] in have:
                    size += 1
                at, count = at + size, count + 1
            assert n == count


def test_language_id_held_out(spark):
    got = Q.op10(spark, LARGE).join(spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_language_id_of_many_scripts(spark):
    """Two languages in each of four scripts, told apart by their letters; one script has 600."""
    rng = random.Random(31)
    scripts = [range(0x61, 0x7B), range(0x430, 0x450), range(0x628, 0x64B), range(0x4E00, 0x4E00 + 600)]
    rows, n = [], 0
    for k, script in enumerate(scripts):
        for j in range(2):
            lexicon = ["".join(chr(rng.choice(script)) for _ in range(3)) for _ in range(300)]
            for _ in range(60):
                rows.append((n, " ".join(rng.choices(lexicon, k=60)), f"{k}{j}"))
                n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("doc_id") % 3 > 0)
    assert len(model.symbols) == 2
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs.where("doc_id % 3 = 0"), model).collect()}
    assert len(got) == 160 and [got[i] for i, _, _ in rows if i in got] == [lang for i, _, lang in rows if i in got]


def test_language_id_trains_on_all_parts_of_a_text():
    rows = [("x", "ab " * 1000 + "cd " * 1000, (i * 7919 % 1000) / 1000 + i / 2**30) for i in range(40)]
    out = langid._sampler(30_000)(pd.DataFrame(rows, columns=["lang", "text", "h"]))["sample"][0]
    assert out.count("c") > 1000 and out.count("a") > 1000 and len(out) <= 30_001


def test_language_id_odd_rows(odd, none):
    model = langid.fit(odd, F.lit(True))
    got = langid.identify(odd, model).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert [by_id[i].lang_pred for i in (1, 2, 3, 11, 14)] == ["und"] * 5
    assert {r.lang_pred for r in got} <= {"und", "en", "fr", "la"} and by_id[7].lang_pred == "la"
    assert langid.identify(none, model).collect() == []
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(none, F.lit(True))).collect()} == {"und"}
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.lang_pred != "und" for r in got)


def test_language_filter_without_any_label(spark):
    texts = ["a plain text", "漢字", "12 34 !!", "", None, "é"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert model.langs == []
    assert sorted(r.doc_id for r in langid.keep_identified(docs, model).collect()) == [0, 1, 5]


def test_near_copies_part_in_lists_of_full_sets(spark, monkeypatch):
    """A group of copies with more and more words replaced: most lie apart, and their long lists must not
    come to blocks with all members."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(360):
        own = list(words)
        for at in rng.choice(150, i % 9, replace=False):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    given, blocks = [], near_dups._blocks
    monkeypatch.setattr(near_dups, "_blocks", lambda lists, *rest: given.append(lists.count()) or blocks(lists, *rest))
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
    assert len(set(root)) > 40 and sum(given) < 10 * len(rows)


def test_license_training_takes_every_paragraph(spark, monkeypatch):
    """The bound is set by paragraphs far beyond any sample: each row of the corpus counts."""
    seen = []
    fit = licenses.LogisticRegression.fit
    monkeypatch.setattr(licenses.LogisticRegression, "fit", lambda self, df, *rest: seen.append(
        df.where("family = 'unknown'").agg(F.sum("weight"), F.count(F.lit(1))).first()) or fit(self, df, *rest))
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the version of number "), F.col("id").cast("string")).alias("text"))
    licenses.fit(docs)
    half = docs.where("pmod(xxhash64(text), 2) = 0").count()
    assert seen[0][0] == half + 1 and seen[0][1] < 10
