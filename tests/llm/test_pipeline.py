"""The pipeline's stages against plain versions, each on what the one before kept."""

import collections
import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from marketlens.llm import langid, mixing, packing, quality_rules
from marketlens.llm.queries import TOKENIZER, tokenizer_path

from . import plain

SMALL = "/root/testdata/sf0.001"


def stages(spark, docs, folder):
    """Each stage's input and output, written and read again."""
    out = [docs]
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, out[-1], SMALL).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def count(df):
    return collections.Counter(tuple(map(str, r)) for r in df.collect())


def check(spark, docs, folder):
    raw, good, known, single, mixed, packed = stages(spark, docs, folder)
    names = docs.columns
    assert all(x.columns == names for x in (good, known, single, mixed))
    # quality rules: the method's verdict, never above the base rules
    verdict = {(str(r.doc_id), r.n_words): r.kept for r in quality_rules.score(raw).collect()}
    at = names.index("doc_id"), names.index("text")
    pick = lambda rows, keep: collections.Counter({r: n for r, n in rows.items() if keep(r[at[0]], "" if r[at[1]] == "None" else r[at[1]])})
    assert count(good) == pick(count(raw), lambda i, t: verdict[i, len(plain.words(t))])
    assert all(len(plain.words(t)) >= 20 for t in (r.text for r in good.collect()))
    # language ID: texts with a letter stay
    model = langid.fit(good, F.lit(True))
    named = {str(r.doc_id): r.lang_pred for r in langid.identify(good, model).collect()}
    assert count(known) == pick(count(good), lambda i, t: named[i] != "und")
    # near-dedup: all pairs, the smallest id of each group
    rows = [(r.doc_id, r.text) for r in known.collect()]
    groups = plain.near_duplicates([r for r in rows if r[0] is not None])
    kept = {str(i) for i, (_, c) in groups.items() if i == c} | {"None"}
    assert set(count(single)) == set(pick(count(known), lambda i, t: i in kept))
    assert all(n == 1 for r, n in collections.Counter((r.doc_id, r.text) for r in single.collect() if r.doc_id is not None).items())
    # mixing: each source's words come near its target, no document more than twice
    taken = {str(r.doc_id): r for r in mixing.taken(single).collect()}
    times = count(mixed)
    assert set(times) <= set(count(single))
    by_source = collections.Counter()
    for r in mixing.taken(single).collect():
        by_source[r.source] += r.taken
    for r in taken.values():
        assert by_source[r.source] == math.floor(r.target)
    # packing: every token of every row of the mix once, gapless within its sequence
    tokens = packing.pieces(mixed, tokenizer_path(TOKENIZER)).agg(F.sum("length")).first()[0]
    pieces = packed.collect()
    assert sum(r.length for r in pieces) == (tokens or 0)
    places = collections.defaultdict(list)
    for r in pieces:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and sum(n for _, n in x) <= packing.SIZE
    return pieces


def test_stages_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pieces = check(spark, docs, tmp_path)
    whole = P.run(spark, SMALL).collect()
    key = lambda r: (str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert collections.Counter(map(key, whole)) == collections.Counter(map(key, pieces)) and len(whole) > 50


def test_odd_rows_and_no_rows(spark, tmp_path):
    rows = plain.odd_rows()
    words = " ".join(f"number{i} stands here" for i in range(30))
    extra = [(50, words, "en", "b"), (50, words, "en", "b"), (51, words + " and more", None, None), (None, words, "en", "c")]
    rows += [(i, t, lang, src, len(t), *rows[0][5:]) for i, t, lang, src in extra]
    check(spark, plain.odd_docs(spark, rows).repartition(3), tmp_path / "odd")
    assert check(spark, plain.odd_docs(spark, []), tmp_path / "none") == []


@pytest.mark.parametrize("k", range(len(P.STAGES)))
def test_stages_are_named_once(k):
    names = [n for n, _ in P.STAGES]
    assert names.count(names[k]) == 1 and callable(P.STAGES[k][1])
