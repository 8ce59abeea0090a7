import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.negatives import bounds, hard_negatives, hilbert, op11_hard_negatives, products

NAMES = "vec_id bigint, embedding array<float>, label int, block string, ids string, dim string, score string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], NAMES)


def brute(rows, is_anchor):
    """(anchor, positive, rank, negative, scores) by comparing every row with every anchor."""
    kept = set()
    for vec_id, vec, label in rows:
        if None in (vec_id, vec, label) or not vec or any(x is None or not math.isfinite(x) for x in vec):
            continue
        kept.add((vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in vec)))
    out = []
    for a in kept:
        if not is_anchor(a[0]):
            continue
        others = [(-sum(x * y for x, y in zip(a[2], b[2])), *b) for b in kept if b != a and len(b[2]) == len(a[2])]
        others.sort(key=lambda s: (*s[:3], np.array(s[3], np.int32).tobytes()))
        for p in [s for s in others if s[2] == a[1]][:5]:
            fit = [s for s in others if s[2] != a[1] and -50 * p[0] <= -100 * s[0] <= -95 * p[0]]
            out += [(a[0], p[1], k, n[1], -p[0], -n[0]) for k, n in enumerate(fit[:3], 1)]
    return sorted(out)


def found(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def test_hilbert_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (1, 5)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes))).T
        key = hilbert(cells, bits)
        assert sorted(key) == list(range(1 << (bits * axes)))
        walk = cells[:, np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=1)).sum(0) == 1).all()


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(1)
    a, v = rng.integers(-300, 300, (5, 9)).astype(np.int32), rng.integers(-300, 300, (40, 9)).astype(np.int32)
    low, high = bounds(a, v.min(0)[None], v.max(0)[None])
    s = products(a, v)
    assert (low[:, 0] <= s.min(1)).all() and (high[:, 0] >= s.max(1)).all()
    big = np.full((1, 64), (1 << 22) - 1, np.int32)
    assert products(big, big)[0, 0] == 64 * ((1 << 22) - 1) ** 2


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = found(op11_hard_negatives(spark, sf))
    assert len(got) > 100
    assert got == brute(rows, lambda i: i % 50 == 0)


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    near = [(k, (rng.normal(size=3) * 0.4 + 1).round(1).tolist(), k % 2) for k in range(1, 60)]
    odd = [
        (0, [1.0, 1.0, 1.0], 0), (0, [1.0, 1.0, 1.0], 0), (0, [1.0, 0.9, 1.1], 0), (0, [1.0, 0.9, 1.1], 1), (50, [1.0, 1.0], 0),
        (100, [1.0, 0.5], 0), (101, [0.5, 0.7], 1), (150, None, 1), (200, [], 1), (250, [1.0, None, 2.0], 1), (300, [1.0, float("nan"), 1.0], 1),
        (350, [float("inf"), 1.0, 1.0], 0), (400, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 0), (450, [0.0, 0.0, 0.0], 0),
        (500, [-1.0, -1.0, -1.0], 1), (550, [1.0] * 4, 3), (7, [1.0, 1.0, 1.0], 0), (8, [1.0, 1.0, 1.0], 0),
    ]
    got = found(hard_negatives(frame(spark, near + odd), F.col("vec_id") % 50 == 0))
    assert got and got == brute(near + odd, lambda i: i % 50 == 0)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, None, None)], [(0, [1e6], 1), (1, [1.0], 1), (2, [1.0], 2)]])
def test_nothing_to_find(spark, rows):
    assert found(hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)) == []
