"""Hard negatives against brute force; bounds hold; shard borders, hot labels, odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmend.llm import negative_mining as N


def brute(rows, asked, positives=5, negatives=10):
    """Rows of (id, label, vector) or odd ones; in Python's whole numbers."""
    fine = {(i, l, tuple(math.floor(256 * x) for x in v)) for i, l, v in rows
            if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, l, v in fine:
        if not asked(i):
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in fine if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in score if x[2] == l)[:positives]:
            inside = sorted(x for x in score if x[2] != l and 30 * -s <= 100 * -x[0] <= 90 * -s)
            out += [(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, l, v, "x") for i, l, v in rows], "vec_id long, label int, embedding array<double>, rank string")


def mined(df, **options):
    return sorted(tuple(r) for r in N.mine(df, F.col("vec_id") % 10 == 0, **options).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def some_rows(n, length, seed, labels=5, spread=0.4):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((labels, length)) + 0.5
    label = rng.integers(0, labels, n)
    label[: n // 3] = 0  # a hot label
    x = centre[label] + spread * rng.standard_normal((n, length))
    return [(int(i), int(l), v.tolist()) for i, l, v in zip(rng.permutation(n), label, x)]


@pytest.mark.parametrize("shard_rows,length", [(40, 24), (4096, 24), (100, 7), (100, 1)])
def test_against_brute_force(spark, shard_rows, length):
    rows = some_rows(400, length, seed=length)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 100 and mined(frame(spark, rows), shard_rows=shard_rows) == want


def test_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(i % 3), rng.integers(0, 2, 4).astype(float).tolist()) for i in range(150)]
    rows += rows[:60] + [(200 + i, 1, [1.0, 1.0, 0.0, 1.0]) for i in range(30)] + [(30, 2, [1.0, 1.0, 1.0, 1.0]), (30, 0, [0.0, 1.0, 1.0, 1.0])]
    assert mined(frame(spark, rows), shard_rows=50) == brute(rows, lambda i: i % 10 == 0)


def test_odd_vectors(spark):
    rows = some_rows(80, 5, seed=6) + some_rows(60, 3, seed=7)
    rows += [(10, None, [1.0] * 5), (None, 1, [1.0] * 5), (20, 1, None), (30, 1, []), (40, 1, [1.0, None, 1.0, 1.0, 1.0]),
             (50, 1, [float("nan")] * 5), (60, 1, [float("inf")] * 5), (70, 1, [0.0] * 5), (500, 1, [1.0, 2.0]),
             (110, 1, [2.0**40] * 5), (113, 1, [2.0**19, 1.0, 0.0, 0.0, 0.0]), (117, 2, [2.0**18, 1.0, 0.0, 0.0, 0.0])]
    want = [r for r in brute(rows, lambda i: i % 10 == 0) if abs(r[4]) < 2**62 and abs(r[5]) < 2**62]
    got = [r for r in mined(frame(spark, rows), shard_rows=30) if abs(r[4]) < 2**62 and abs(r[5]) < 2**62]
    assert got == want
    assert mined(frame(spark, rows).limit(0)) == []
    assert mined(frame(spark, [(1, 1, [1.0])])) == []
    assert mined(frame(spark, [(10, 1, [1.0]), (11, 1, [1.0])])) == []  # no other label


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(9)
    strength = 0.8 ** np.arange(64)  # as embeddings have it: few strong directions, at any angle to the components
    x = np.floor(256 * (rng.standard_normal((3000, 64)) * strength) @ np.linalg.qr(rng.standard_normal((64, 64)))[0]).astype("int64")
    rotation = N.fitted_rotation(x[:500].astype("float64"))
    assert np.allclose(rotation @ rotation.T, np.eye(64))
    shard = N.Shard(np.arange(3000), rng.integers(0, 4, 3000), x, rotation)
    s, rows = shard.summaries, np.arange(3000)
    own = [(m[0], d[0], s.size[0]) for m, d in s.levels]
    widths = []
    for level, (mean, deviation, size) in enumerate(own):
        low, high = s.bounds(level, rows, mean, deviation, size)
        assert ((low <= x @ x[0]) & (x @ x[0] <= high)).all()
        widths.append((high - low).mean())
    assert widths[0] > 2 * widths[1] > 4 * widths[2]
    same = np.flatnonzero((shard.labels == shard.labels[0]) & (rows != 0))
    got, score = shard.positives(0, int(shard.labels[0]), x[0], own, 5)
    assert score.tolist() == sorted((x[same] @ x[0]).tolist(), reverse=True)[:5]
    assert shard.scored < len(same) / 20
    before = shard.scored
    shard.negatives(0, int(shard.labels[0]), x[0], own, *N.Window100().limits(score), 10)
    assert shard.scored - before < 3000 / 10
