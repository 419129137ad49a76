"""Hard negatives and the cover tree against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import cover_tree, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=10, k=5):
    ok = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and v is not None and lab is not None
          and all(x is not None and math.isfinite(256 * x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, v, lab) in enumerate(ok):
        if i % every:
            continue
        scored = [(-dot(v, w), j, other) for m, (j, w, other) in enumerate(ok) if m != n]
        for p, j, _ in sorted(x for x in scored if x[2] == lab)[:k]:
            far = sorted(x for x in scored if x[2] != lab and 80 * -p <= 100 * -x[0] <= 100 * -p)[:k]
            out += [(i, j, r, f[1], -p, -f[0]) for r, f in enumerate(far, 1)]
    return sorted(out)


def mined(spark, rows, every=10, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).withColumn("row", F.lit("x")).withColumn("id", F.lit(1)).withColumn("score", F.lit(2.0))
    return sorted(tuple(r) for r in hard_negatives.mine(df, "vec_id", "embedding", "label", F.col("vec_id") % every == 0).collect())


def table(seed, n=400, d=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(8)]
    return [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)], rng.randint(0, 3)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "BLOCK", 150)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rows = table(seed)
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_ties_and_copies(spark):
    """A third of all rows have one vector; whole rows repeat, anchors among them."""
    rows = table(3, 120) + [(1000 + i, [1.0, 0.5, 0.25, 0.0, 0.0, 0.0], i % 3) for i in range(80)]
    rows += rows[:12] + [(50, [0.0] * 6, 1)] * 3
    assert mined(spark, rows) == brute(rows)


def test_nulls_lengths_and_odd_values(spark):
    rows = table(4, 60) + [
        (None, [1.0], 0), (100, None, 0), (110, [1.0, None], 0), (120, [float("nan")] * 6, 1), (130, [float("inf")] * 6, 1), (140, [1.0] * 6, None),
        (150, [], 0), (160, [2.0], 0), (170, [1.0] * 9, 1), (-10, [-1.0] * 6, 1), (180, [1e308] * 6, 1)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == [] and mined(spark, [(10, [1.0], 0)]) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** 17 + i), 1e5 - i, 0.001 * i], i % 2) for i in range(40)]
    assert mined(spark, rows) == brute(rows)
    wide = [(i, [2.0 ** 48 + 3 * i, 1.0 * i], i % 2) for i in range(20)]  # products of more than 64 bits
    with pytest.raises(Exception):
        mined(spark, wide)


@pytest.mark.parametrize("n,d,shape", [(6000, 64, "sphere"), (4000, 16, "clusters"), (900, 2, "mixed")])
def test_tree_covers_and_searches(n, d, shape):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, d))
    if shape == "clusters":
        x = rng.normal(size=(20, d))[rng.integers(0, 20, n)] + 0.1 * x
    if shape == "mixed":
        x *= rng.exponential(size=(n, 1))
    points = np.floor(256 * x / np.linalg.norm(x, axis=1).max()).astype(np.int64)
    ids, rows, labels = rng.permutation(n), np.arange(n), rng.integers(0, 6, n)
    tree = cover_tree.Tree.loads(cover_tree.build(points, ids, rows, labels).dumps())
    assert sorted(tree.rows.tolist()) == list(range(n)) and (tree.parent[1:] < np.arange(1, len(tree.parent))).all()
    q = np.arange(0, n, 29)
    scores = points[q] @ points.T
    top = np.sort(scores, axis=1)[:, -9]
    low, high = np.ceil(0.8 * top).astype(np.int64), top
    got = cover_tree.search(tree, points[q], labels[q], rows[q], low, high, False, 5)
    want = []
    for i, r in enumerate(q):
        fits = np.flatnonzero((labels != labels[r]) & (scores[i] >= low[i]) & (scores[i] <= high[i]))
        want += [(i, -s, j) for s, j in sorted((-scores[i, f], ids[f]) for f in fits)[:5]]
    assert list(zip(*(g.tolist() for g in got))) == want


def test_leaves_outside_windows_are_skipped(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 5000)] + 0.05 * rng.normal(size=(5000, 16))
    points = np.floor(256 * x / np.linalg.norm(x, axis=1).max()).astype(np.int64)
    tree = cover_tree.build(points, np.arange(5000), np.arange(5000), np.zeros(5000, np.int64))
    seen = []
    real = cover_tree._products
    monkeypatch.setattr(cover_tree, "_products", lambda q, p, e: seen.append(len(q) * len(p)) or real(q, p, e))
    q = points[:50]
    cover_tree.search(tree, q, np.zeros(50), np.arange(50), np.full(50, -np.inf), np.full(50, np.inf), True, 5)
    assert sum(seen) < 0.3 * 50 * 5000
