"""The prefix trie against a plain version on rebuilt texts."""

import collections
import hashlib
import random
import zlib

import pytest

from marketlens.llm import prefix_trie
from marketlens.llm import queries as Q
from tests.compare import digest

from . import plain

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth string, words string, base int, k1 string, source string, ends int, saved int, n_convs string"


def plain_trie(rows):
    stored = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            stored[c].append((turn is not None, turn or 0, role or "", text or ""))
    stored = {c: [t[2:] for t in sorted(x, key=lambda t: t[:2])] for c, x in stored.items()}
    built = {}
    for c, own in stored.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(stored.get(c - c % 20, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        own = (len(m) - 1) * (len(plain.words(p[-1][1])) if p else 0)
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not children[p]
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()]


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "z", "z", 1, "z", "z", 1, 1, "z") for r in rows], SCHEMA).repartition(parts)
    got = [tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(df).collect()]
    assert sorted(got, key=str) == sorted(plain_trie(rows), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain_and_sql(spark, sf):
    import duckdb

    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in Q.QUERIES["op12_prefix_trie"](spark, f"/root/testdata/{sf}").collect()]
    assert sorted(got, key=str) == sorted(plain_trie(rows), key=str)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '/root/testdata/{sf}/conversations.parquet'")
    cur = con.execute(Q.ORACLES["op12_prefix_trie"])
    assert digest(COLUMNS, got)[0] == digest([d[0] for d in cur.description], cur.fetchall())[0]


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 130), *range(-45, 0, 4), 10**12 + 3]:
        if c % 20 == 0 and c % 60 == 0:
            continue  # a family without its base
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, rng.choice([turn, turn, None]) if turn == 0 else turn, rng.choice(["user", "user", None, ""]), rng.choice(["a", "a", "a b", None, "", "é  x\ty"])))
    rows += [(None, 1, "user", "a"), (77, 90, "user", "again"), (77, 90, "user", "again"), (78, 5, "a", "ab"), (79, 5, "aa", "b")]
    rows += [(200, t, "user", f"long {t % 3}") for t in range(700)] + [(207, t, "user", f"long {t % 3}") for t in range(700)]
    check(spark, rows)
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_borders_of_partitions_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    monkeypatch.setattr(prefix_trie, "PART_ROWS", 3)  # families, heads and conversations cross borders
    rng = random.Random(9)
    rows = [(c, t, "user", rng.choice("ab")) for c in range(0, 60) for t in range(rng.choice([1, 2, 3, 5, 9]))]
    rows += [(100 + c, t, "x", "same words here") for c in (0, 1, 2) for t in range(40)]
    check(spark, rows)


def test_a_shared_fingerprint_takes_the_next_base(spark, monkeypatch):
    # with R = 0 a fingerprint is that of the first turn alone
    monkeypatch.setattr(prefix_trie, "_power", lambda r, n, old=prefix_trie._power: (n == 0).astype("uint64") if r == 1 else old(r, n))
    monkeypatch.setattr(prefix_trie, "BASES", ((1, 1), prefix_trie.BASES[1]))
    check(spark, [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (2, 1, "u", "c"), (2, 2, "u", "d")])
