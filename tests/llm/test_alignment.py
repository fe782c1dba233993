"""Cross-tokenizer alignment against whole encodings, byte by byte."""

import bisect
import collections
import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from marketlens.llm import alignment
from marketlens.llm import queries as Q

from . import plain

SMALL = "/root/testdata/sf0.001"
A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    return whole, SentencePieceProcessor(model_file=B), alignment.Side(A), alignment.Side(B)


def spans(ids, side):
    end, out = 0, []
    for i in ids:
        end += len(side.bytes[i])
        out.append((i, end))
    return out


def plain_groups(text, libraries):
    """[(A ids, B ids)] of the groups of a text, from whole encodings."""
    whole, pieces, side_a, side_b = libraries
    full = (" " + (text or "")).encode()
    a, b = whole.encode(full.decode(), add_special_tokens=False).ids, pieces.encode(text or "")
    if not text or b"".join(side_a.bytes[i] for i in a) != full or b"".join(side_b.bytes[i] for i in b) != full:
        return []
    a, b = spans(a, side_a), spans(b, side_b)
    cuts = sorted({e for _, e in a} & {e for _, e in b})
    groups = [([], []) for _ in cuts]
    for k, side in enumerate((a, b)):
        for i, e in side:
            groups[bisect.bisect_left(cuts, e)][k].append(i)
    return groups


def plain_rows(rows, libraries):
    found = [(i, plain_groups(t, libraries)) for i, t in rows]
    count = collections.Counter()
    for _, groups in found:
        count.update({(a, b) for x, y in groups for a in x for b in y})
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for i, groups in found:
        pairs = [(a, b) for x, y in groups for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(pairs),
                    sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def test_query_against_plain(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in Q.QUERIES["op13_token_alignment"](spark, SMALL).collect()]
    assert sorted(got) == sorted(plain_rows(rows, libraries))


def test_odd_rows_and_rare_pairs(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 50)  # most pairs meet their counts in the join
    odd = plain.odd_docs(spark).repartition(3).cache()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in alignment.summed(odd, A, B).collect()]
    assert sorted(got, key=str) == sorted(plain_rows(rows, libraries), key=str)
    none = plain.odd_docs(spark, [])
    assert alignment.summed(none, A, B).collect() == [] and alignment.align(none, A, B).collect() == []


def test_aligned_tokens_and_overlaps(spark, libraries):
    rng = random.Random(5)
    signs = [*"ab Z09.,'\n\t é漢ß😀<|>s_▁", " ", "　", "\u0085", " the", "'s", " <|endoftext|>", "<s>", " ing", "  ", " \n", "word word2 word3 "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in alignment.align(df, A, B).collect():
        groups = plain_groups(texts[r.doc_id], libraries)
        for ids, at, k in ((r.a_ids, r.a_groups, 0), (r.b_ids, r.b_groups, 1)):
            got = collections.defaultdict(list)
            for i, g in zip(ids, at, strict=True):
                got[g].append(i)
            assert [got[g] for g in range(len(groups))] == [g[k] for g in groups], repr(texts[r.doc_id])
        a, b = ([(s, e) for s, e in zip([0, *ends[:-1]], ends, strict=True)] if ends else [] for ends in (r.a_ends, r.b_ends))
        expected = [(i, j) for i, (s, e) in enumerate(a) for j, (u, v) in enumerate(b) if max(s, u) < min(e, v)]
        assert [tuple(o) for o in r.overlaps] == expected


def test_a_group_of_many_tokens_is_listed_in_parts(monkeypatch, libraries):
    import numpy as np

    ids = np.arange(300) % 7
    side = (ids, np.arange(300), np.zeros(300, np.int64))
    one = alignment.links(side, side, np.zeros(300, np.int64), np.zeros(300, np.int64))
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 5)
    two = alignment.links(side, side, np.zeros(300, np.int64), np.zeros(300, np.int64))
    assert all((x == y).all() for x, y in zip(one, two, strict=True)) and one[2].sum() == 300 * 300 and len(one[0]) == 49


def test_workers_keep_no_chunks_after_a_task(spark):
    docs = spark.createDataFrame([(k, f"word{k} and more words of {k} kinds") for k in range(400)], "doc_id long, text string").repartition(8)

    def held(batches):
        import sys

        import pyarrow as pa

        for _ in batches:
            store = vars(sys.modules.get("marketlens_worker", type(sys)("none")))
            some = [len(e.at) for k, e in store.items() if isinstance(k, tuple)]
            yield pa.RecordBatch.from_arrays([pa.array([len(some)]), pa.array([sum(some)])], ["workers", "chunks"])

    found = alignment.linked(docs, A, B)
    assert found.agg({"n_links": "sum"}).first()[0] > 0
    got = spark.range(0, 64, 1, 16).mapInArrow(held, "workers long, chunks long").groupBy().sum("workers", "chunks").first()
    assert got[0] > 0 and got[1] == 0
