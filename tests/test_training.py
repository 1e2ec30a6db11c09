"""Training with mined negatives: loss and gradient against the formula, sums over tasks, stops, what is learnt."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrove.operators import optimise, training

DIMS = (3, 6)


def unit(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")


def brute_loss(w, q, p, negatives, dims=DIMS):
    """Cross entropy of the positive at each nested dimension, number by number."""
    total = 0.0
    for k in dims:
        y = [w[:k] @ v for v in (q, p, *negatives)]
        y = [v / math.sqrt(sum(v * v)) for v in y]
        s = [sum(y[0] * v) / training.TEMPERATURE for v in y[1:]]
        total += -math.log(math.exp(s[0] - max(s)) / sum(math.exp(x - max(s)) for x in s))
    return total / len(dims)


def test_loss_and_gradient():
    q, p, n = unit(5, 8, 1), unit(5, 8, 2), unit(15, 8, 3).reshape(5, 3, 8)
    w = 0.3 * np.random.default_rng(4).normal(size=(6, 8))
    loss, grad = training.losses_and_gradient(w, q, p, n, DIMS)
    assert np.allclose(loss, [brute_loss(w, *x) for x in zip(q, p, n)])
    for i, j in ((0, 0), (2, 5), (3, 1), (5, 7)):  # rows of the inner slice and of the outer one
        e = np.zeros_like(w)
        e[i, j] = 1e-6
        slope = sum(brute_loss(w + e, *x) - brute_loss(w - e, *x) for x in zip(q, p, n)) / 2e-6
        assert abs(slope - grad[i, j]) < 1e-4 * max(1, abs(slope))


def mined(spark, x, noise=0.03, pool=16):
    band = frame(spark, x)
    q = frame(spark, x + noise * unit(*x.shape, 9))
    own = band.select(F.col("id").alias("a"), F.col("id").alias("b"))
    return q, band, own, optimise.hard_negatives(q, band, own, pool, 4)


def test_sums_over_tasks(spark):
    x = unit(60, 8, 5)
    q, band, own, negatives = mined(spark, x)
    known = training.examples(q, band, own, negatives)
    rows = known.orderBy("a").collect()
    assert [r.a for r in rows] == list(range(60)) and all(len(r.n) == 32 for r in rows)
    slots = {(r.a, r.slot): r.b for r in negatives.collect()}
    assert all(np.allclose(np.reshape(r.n, (4, 8)), [x[slots[r.a, k]] for k in range(4)]) and np.allclose(r.p, x[r.a]) for r in rows)
    w = 0.3 * np.random.default_rng(6).normal(size=(6, 8))
    loss, grad = training.losses_and_gradient(w, *(np.array([r[c] for r in rows]) for c in ("q", "p")), np.array([np.reshape(r.n, (4, 8)) for r in rows]), DIMS)
    count, total, summed = training.summed_gradient(known.repartition(7), w, DIMS)
    assert count == 60 and np.isclose(total, loss.sum()) and np.allclose(summed, grad)
    assert training.summed_gradient(known.limit(0), w, DIMS)[0] == 0
    assert np.allclose([r.loss for r in training.example_losses(known, w, DIMS).orderBy("a").collect()], loss)


def test_training_lowers_the_loss_and_finds_positives(spark):
    x = unit(160, 12, 7)
    seen = []
    t = training.train(*mined(spark, x), dims=(6, 12), steps=25, batch=32, rate=0.02, progress=lambda *a: seen.append(a))
    assert t.w.shape == (12, 12) and t.steps == 25 and t.stopped == "" and len(seen) == 25
    assert np.mean([s[1] for s in seen[-4:]]) < 0.7 * np.mean([s[1] for s in seen[:4]])  # all four shares
    assert t.dev_rate > 0.8


def test_stops(spark, monkeypatch):
    x = unit(80, 8, 8)
    data = mined(spark, x, noise=0.8)
    with pytest.raises(ValueError):
        training.train(*data, dims=DIMS, batch=500)
    monkeypatch.setattr(training, "PATIENCE", 2)
    t = training.train(*data, dims=DIMS, steps=9, batch=80, rate=0.0)
    assert t.stopped == "plateau" and t.steps == 3
    monkeypatch.setattr(training, "DEV_STEP", 1)
    monkeypatch.setattr(training, "DEV_LEAST", 1.1)
    t = training.train(*data, dims=(50,), steps=9, batch=20)
    assert t.stopped == "dev" and t.steps == 1 and t.w.shape == (8, 8)  # no such dimension: the base's own
    monkeypatch.setattr(training, "LOSS_FLOOR", 1e9)
    assert training.train(*data, dims=DIMS, steps=2, batch=20).stopped == ""
