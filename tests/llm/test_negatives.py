"""Hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlas.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score double, rank string, v int"


def brute(rows, every=100, k=5, low=80, high=100):
    """Of all pairs, in whole numbers; rows: vec_id, vector, label."""
    least, most = -(1 << 63), (1 << 63) - 1
    cut = lambda x: min(max(x, least), most)
    whole = [(i, y, tuple(cut(int(np.floor(256 * x))) for x in v)) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, y, v in whole:
        if i % every == 0:
            best = asked.setdefault((i, len(v)), (y, v))
            asked[i, len(v)] = min(best, (y, v))
    out = []
    for (i, n), (y, v) in asked.items():
        others = sorted((-cut(sum(a * b for a, b in zip(v, w))), j, z) for j, z, w in whole if j != i and len(w) == n)
        mates = [(j, -s) for s, j, z in others if z == y][:k]
        for place, (positive, score) in enumerate(mates, 1):
            fit = [(j, -s) for s, j, z in others if z != y and low * score <= -100 * s <= high * score][:k]
            out += [(i, positive, rank, j, score, s, place) for rank, (j, s) in enumerate(fit, 1)]
    return sorted(out)


def found(frame, label="label", **options):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"]
    return sorted(tuple(r[n] for n in names) for r in negatives.mine(frame, F.col(label), **options).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 64)
    r = random.Random(seed)
    rows = [(i, [r.gauss(0.1, 0.3) for _ in range(9)], r.randrange(3)) for i in range(900)]
    want = brute(rows)
    assert len(want) > 150 and found(spark.createDataFrame([(*x, 0.0, "r", 1) for x in rows], SCHEMA).repartition(5)) == want
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 200)  # several passes
    assert found(spark.createDataFrame([(*x, 0.0, "r", 1) for x in rows], SCHEMA)) == want


def test_odd_rows(spark):
    """Nulls, non-finite and extreme components, ties, repeated rows and ids, other lengths, an empty vector, clashing names."""
    r = random.Random(5)
    same = [0.5, 0.25, -0.125]
    rows = [(0, same, 1), (0, [0.75, 0.25, 0.0], 1), (1, same, 1), (2, same, 1), (2, same, 1), (3, same, 0), (3, same, 0), (4, same, 2), (None, same, 0), (5, None, 0), (6, same, None), (7, [0.5, None, 1.0], 0), (8, [float("nan"), 0.0, 0.0], 0), (9, [float("inf"), 0.0, 0.0], 0)]
    rows += [(100, [1.0], 0), (101, [0.9], 0), (102, [0.8], 1), (103, [0.7], 1), (200, [], 0), (201, [], 0), (202, [], 1), (300, [1e30, 1.0, 2.0], 1), (301, [1e12, -1e12, 1e3], 1), (302, [9e11, -1e12, 1e3], 2), (303, [1e300, 0.0, 0.0], 2)]
    rows += [(400 + i, [r.uniform(-1e9, 1e9) for _ in range(4)], i % 2) for i in range(40)]
    got, want = found(spark.createDataFrame([(*x, 0.0, "r", 1) for x in rows], SCHEMA)), brute(rows)
    assert got == want and any(x[0] == 200 for x in got) and any(x[0] == 400 for x in got)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == [] and found(spark.createDataFrame([(100, [1.0], 1, 0.0, "", 1), (1, [1.0], 2, 0.0, "", 1)], SCHEMA)) == []


def test_intervals_drop_candidates():
    """Most vectors go before their last plane, and none that counts."""
    r = np.random.default_rng(3)
    rows = r.integers(-256, 257, (4000, 16))
    block = negatives.Sliced(np.arange(4000), np.zeros(4000, np.int64), rows)
    assert (sum((-(1 << b) if b == block.bits - 1 else 1 << b) * p.astype(np.int64) for b, p in enumerate(block.planes)) == rows.T).all()
    anchor = negatives.Anchor(-1, 1, rows[0], [(0, 60_000, 1, 60_000)], 5)
    alive, scores = anchor.sift(block, np.arange(4000))
    exact = rows @ rows[0]
    assert len(alive) < 100 and (scores == exact[alive]).all()
    inside = sorted(exact[(exact >= 0) & (exact <= 60_000)])[-5:]
    assert set(inside) <= set(scores.tolist())
