import math

import numpy as np
import pytest

from deltaweave.llm import kdtree_topk as t
from pyspark.sql import functions as F


def brute(rows, is_query, k, scale=64):
    good = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if not is_query(q):
            continue
        own = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(own, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 40.0, 1e6])
def test_equals_brute_force(spark, spread):
    rng = np.random.default_rng(int(spread))
    rows = [(i, (rng.normal(size=6) * spread).astype(np.float32).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2001, [1.0, None] * 3), (2002, [float("nan")] * 6), (2020, [float("inf")] * 6), (2040, [1.0, 2.0]), (2060, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x")).withColumn("score", F.lit(1))
    got = t.top_k(df, F.col("vec_id") % 20 == 0, k=7, shard_rows=90, block_rows=11, leaf=16)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, lambda i: i % 20 == 0, 7)
    assert t.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in t.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 64 * 128)]


def test_boxes_prune():
    rng = np.random.default_rng(0)
    vecs = np.repeat(rng.integers(-500, 500, (20, 3)), 200, 0) + rng.integers(-3, 3, (4000, 3))
    tree = t.KdTree(np.arange(4000), vecs, 64)
    seen = []
    tree.start = type("L", (list,), {"__getitem__": lambda s, i: (seen.append(i), list.__getitem__(s, i))[1]})(tree.start)
    (_, ids, scores), = tree.search(np.array([-1]), np.array([[300, -200, 100]]), np.array([-(1 << 62)]), 5)
    assert scores.tolist() == sorted((vecs @ [300, -200, 100]).tolist(), reverse=True)[:5]
    assert len(seen) < 12


def test_regions_and_copies(spark):
    """Regions are parts of space, copies of one vector (and of one row) are cut into pieces, results stay exact."""
    rng = np.random.default_rng(5)
    places = rng.integers(-90, 90, (12, 4))
    rows = [(i, (places[i % 12] + rng.normal(size=4)).tolist()) for i in range(1500)]
    rows += [(5000 + i, rows[7][1]) for i in range(700)] + [rows[20]] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = t.top_k(df, F.col("vec_id") % 50 == 0, k=9, shard_rows=100, block_rows=10, leaf=16, sample=600)
    expected = brute([r for r in rows if r[0] != 20], lambda i: i % 50 == 0, 30)
    best = {}
    for q, _, i, s in expected:
        best.setdefault(q, []).append((-s, i))
    for i, v in [rows[20]] * 4:  # the repeated row is a candidate each time
        for q in best:
            a, b = (np.floor(64 * np.array(x)).astype(int) for x in (dict(rows)[q], v))
            best[q].append((-int(a @ b), i))
    flat = [(q, r, i, -s) for q, c in best.items() for r, (s, i) in enumerate(sorted(c)[:9], 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(flat)


def test_regions_split_space():
    rng = np.random.default_rng(1)
    vecs = rng.integers(-100, 100, (1000, 3))
    cut = t.Regions(vecs, 100)
    at = cut.of(vecs)
    sizes = np.bincount(at, minlength=cut.n)
    assert cut.n >= 10 and sizes.min() >= 16 and sizes.max() <= 100
    assert t.Regions(np.ones((500, 3), np.int64), 10).n == 1
