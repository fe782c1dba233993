"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from marketlens.llm import queries as Q
from marketlens.llm import vantage

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, print int, score string, ids int, dim string, shard int, block string"


def brute(rows, k=20, is_query=lambda i: i % 20 == 0):
    """{(query id, vector): [(vec_id, score)]} of distinct rows of usable vectors."""
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in sorted(fine):
        if is_query(i):
            near = [(j, (np.array(u) * np.array(v)).sum()) for j, u in fine if (j, u) != (i, v) and len(u) == len(v)]
            out[i, v] = sorted(near, key=lambda x: (-x[1], x[0]))[:k]
    return out


def as_lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_query_recall_and_ranks(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    expected = {i: near for (i, _), near in brute(rows).items()}
    found = Q.QUERIES["op11_vantage_neighbours"](spark, "/root/testdata/sf0.1")
    assert found.columns == ["query_id", "rank", "vec_id", "score"] and dict(found.dtypes)["rank"] == "int"
    got = as_lists(found)
    assert set(got) == set(expected) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({j for j, _ in got[i]} & {j for j, _ in expected[i]}) / 20 for i in expected])
    assert recall >= 0.98
    vectors = {i: np.array(v, float) for i, v in rows}
    for i, near in got.items():
        assert [j for j, _ in near] == [j for j, _ in sorted(near, key=lambda x: (-x[1], x[0]))]
        assert np.allclose([s for _, s in near], [vectors[i] @ vectors[j] for j, _ in near], rtol=1e-12)


def test_factor_one_is_exact_over_shards_and_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 6)) * 3
    x = centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 6)) * 0.4  # lengths differ
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000 + i, rows[40][1]) for i in range(100)] + [(-20, rows[40][1])]  # copies, ties by id
    df = spark.createDataFrame([(i, v, 0, "z", 1, "z", 1, "z", 1, "z") for i, v in rows], SCHEMA).repartition(5)
    got = as_lists(vantage.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=400, block_rows=20))
    expected = brute(rows)
    assert set(got) == {i for i, _ in expected}
    for (i, _), near in expected.items():
        assert [j for j, _ in got[i]] == [j for j, _ in near]
        assert np.allclose([s for _, s in got[i]], [s for _, s in near], rtol=1e-12)


def test_search_prunes_with_exact_results():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 4)) * 20
    x = centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 4))
    tree = vantage.Tree.build(x, np.arange(4000), leaf=32)
    q = x[::50]
    got, taken = tree.search(q, 10, 1.0)
    for i, at in enumerate(got):
        assert set(np.argsort(-(x @ q[i]), kind="stable")[:10]) == set(tree.rows[at])
    assert taken < 0.5 * len(q) * len(x)


def test_odd_rows(spark):
    v = [1.0, 0.0, -0.0, 2.0]
    rows = [(0, v), (0, v), (1, None), (2, []), (3, [0.0] * 4), (4, [float("nan")] + v[1:]), (5, [None] + v[1:]), (6, [float("inf")] * 4), (None, v),
            (20, [1.0, 0.0, 0.0, 2.0]), (7, [1.0, 0.0, 0.0, 2.0]), (8, [1.0, 1.0]), (40, [2.0, 2.0]), (60, [1.0]), (-20, [-1.0, 0.0, 0.0, 0.0]), (9, [3e-200] * 4)]
    df = spark.createDataFrame([(i, x, None, "z", 1, "z", 1, "z", 1, "z") for i, x in rows], SCHEMA).repartition(3)
    got = as_lists(vantage.nearest(df, F.col("vec_id") % 20 == 0))
    expected = {i: near for (i, _), near in brute(rows).items() if near}
    assert got == expected and 60 not in got
    assert vantage.nearest(df.limit(0), F.lit(True)).collect() == []
    assert vantage.nearest(df.where("vec_id = 1 or vec_id is null"), F.lit(True)).collect() == []
