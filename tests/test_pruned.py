"""Pruned threshold joins and top-k in rounds against brute force; what is skipped and sent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrove.operators import pruned, simjoin


def clustered(n, d, centers, spread, seed):
    rng = np.random.default_rng(seed)
    c = np.random.default_rng(99).normal(size=(centers, d))
    x = c[rng.integers(0, centers, n)] + spread * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(range(len(x)) if ids is None else ids, x)], "id long, vec array<double>")


def brute(x, y, t, half=False):
    dots = x @ y.T
    return {(i, j) for i, j in zip(*(v.tolist() for v in np.nonzero(dots >= t))) if not half or i < j}


@pytest.mark.parametrize("spread", [0.05, 0.3, 5.0])
def test_pairs(spark, spread):
    x, y = clustered(400, 16, 12, spread, 1), clustered(300, 16, 12, spread, 2)
    y[7] = 0
    for t in (0.3, 0.9):
        found, plan = pruned.similar(frame(spark, x), frame(spark, y), t, pivots=10, stripe_rows=40, block=16)
        rows = found.collect()
        assert {(r.a, r.b) for r in rows} == brute(x, y, t) and len(rows) == len(brute(x, y, t))
        assert all(abs(r.cosine - x[r.a] @ y[r.b]) < 1e-9 for r in rows)
        own, plan_own = pruned.similar(frame(spark, x), None, t, pivots=10, stripe_rows=40, block=16)
        rows = own.collect()
        assert {(r.a, r.b) for r in rows} == brute(x, x, t, True) and len(rows) == len(brute(x, x, t, True))
        if spread == 0.05:
            assert plan.skipped > 0.6 and plan_own.skipped > 0.6
        if spread == 5.0 and t == 0.3:
            assert plan.skipped == 0


def test_blocks_skip_work_below_n_squared():
    x = clustered(4000, 16, 40, 0.05, 3)
    at, near = [0], x @ x[0]
    while len(at) < 40:
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    p = x[at]
    order = pruned.in_order(x, p)
    blocks = list(pruned.multiplied_blocks(x[order], x[order], p, 0.9, True, 16))
    n = 4000 // 16
    assert len(blocks) < 0.2 * n * (n + 1) / 2


def test_long_vectors_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    x = clustered(120, 8, 6, 0.1, 4) * rng.uniform(0.2, 3, (120, 1))
    found, _ = pruned.similar(frame(spark, x), None, 0.8, pivots=6, stripe_rows=20)
    assert {(r.a, r.b) for r in found.collect()} == brute(x, x, 0.8, True)
    d = frame(spark, x)
    odd = d.union(spark.createDataFrame([(None, [1.0] * 8), (900, None)], d.schema))
    assert {(r.a, r.b) for r in pruned.similar(odd, d, 0.8)[0].collect()} == brute(x, x, 0.8)
    for a, b in ((d.limit(0), d), (d, d.limit(0)), (d.limit(0), None), (d.where("id < 0"), None)):
        assert pruned.similar(a, b, 0.5)[0].collect() == []
    with pytest.raises(ValueError):
        pruned.similar(d, None, 0.0)
    names = d.select(F.concat(F.lit("k"), "id").alias("id"), "vec")
    assert {(r.a, r.b) for r in pruned.similar(names, names, 0.8)[0].collect()} == {(f"k{i}", f"k{j}") for i, j in brute(x, x, 0.8)}


def test_joins_take_the_pruned_way(spark, monkeypatch):
    x = clustered(150, 8, 6, 0.1, 6)
    d = frame(spark, x)
    plain = {(r.a, r.b) for r in simjoin.self_pairs(d, 0.9).collect()}
    monkeypatch.setattr(simjoin, "PRUNED_PAIRS", 1)
    assert {(r.a, r.b) for r in simjoin.self_pairs(d, 0.9).collect()} == plain == brute(x, x, 0.9, True)
    assert {(r.a, r.b) for r in simjoin.pairs(d, d, 0.9).collect()} == brute(x, x, 0.9)


def test_joins_that_rule_out_little_take_the_plain_grid(spark, monkeypatch):
    """Vectors without clusters go to few cells each, not to one for each pivot."""
    x = np.random.default_rng(9).normal(size=(300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d, sent = frame(spark, x), []
    cells = simjoin._cells
    monkeypatch.setattr(simjoin, "PRUNED_PAIRS", 1)
    monkeypatch.setattr(simjoin, "_cells", lambda *args: sent.append(args[5]) or cells(*args))
    assert {(r.a, r.b) for r in simjoin.self_pairs(d, 0.4).collect()} == brute(x, x, 0.4, True)
    assert {(r.a, r.b) for r in simjoin.pairs(d, d, 0.4).collect()} == brute(x, x, 0.4)
    assert sent == [(1, 1), (1, 1)]
    simjoin.self_pairs(frame(spark, clustered(300, 8, 6, 0.05, 20)), 0.9).collect()
    assert len(sent) == 2  # clusters are still told apart


def test_nearest_in_rounds(spark, monkeypatch):
    assert simjoin.rounds_of(1500, 1500, 1000) == [(0, 1), (1, 3), (3, 9), (9, 27), (27, 81), (81, 243), (243, 729), (729, 1500)]
    assert simjoin.rounds_of(32, 32, 1000) == [(0, 32)] and simjoin.rounds_of(1, 1, 8) == [(0, 1)]
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(60, 6)), np.round(rng.normal(size=(900, 6)), 1)
    y[100:140] = y[0]  # ties across stripes
    a, b = frame(spark, x), frame(spark, y, rng.permutation(900))
    ids = {r.id: np.array(r.vec) for r in b.collect()}
    monkeypatch.setattr(simjoin, "grid_of", lambda *args: (2, 30))
    monkeypatch.setattr(simjoin, "rounds_of", lambda g, h, cores, f=simjoin.rounds_of: f(g, h, 1))
    sent, cells = [], simjoin._cells
    monkeypatch.setattr(simjoin, "_cells", lambda *args, **kw: sent.append(cells(*args, **kw)) or sent[-1])
    got = {}
    for r in simjoin.nearest(a, b, 5).collect():
        got.setdefault(r.a, {})[r["rank"]] = r.b
    for i in range(60):
        want = sorted(ids, key=lambda j: (-(x[i] @ ids[j]), j))[:5]
        assert [round(float(x[i] @ ids[got[i][k + 1]]), 9) for k in range(5)] == [round(float(x[i] @ ids[j]), 9) for j in want]
    assert len(sent) == 5 and sum(f.count() for f in sent) < 0.35 * 60 * 5 * 30
    few = simjoin.nearest(a, b.limit(3), 5).collect()
    assert len(few) == 180
