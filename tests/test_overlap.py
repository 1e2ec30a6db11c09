"""Jaccard of given pairs: against brute force by stripes and rounds, and what is sent for many pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrove.operators import corpus, overlap


def brute(pairs, sets, most):
    out = []
    for a, b, c in pairs:
        for x in (s for i, s in sets if i == a):
            for y in (s for i, s in sets if i == b):
                j = 1.0 if x is None or y is None else len(set(x) & set(y)) / len(set(x) | set(y))
                out += [(a, b, c, round(j, 9))] if j <= most else []
    return sorted(out)


@pytest.mark.parametrize("text", [False, True])
def test_jaccards_against_brute_force(spark, monkeypatch, text):
    """Long, short, shared by all, shared by none, missing, repeated and null sets, whatever the stripes and rounds."""
    rng = np.random.default_rng(1)
    key = (lambda i: f"k{i}") if text else int
    sets = [(key(i), None if i % 13 == 0 else [int(v) for v in {*rng.integers(0, 60, 1 + i % 40), *range(1000 * i, 1000 * i + i % 3)}] + [-7]) for i in range(60)]
    sets += [(key(5), [1, 2, 3]), (key(90), [4])]
    pairs = [(key(a), key(b), float(a)) for a in range(64) for b in range(a + 1, 64) if (a * b) % 3]
    kind = "string" if text else "long"
    p = spark.createDataFrame(pairs, f"a {kind}, b {kind}, cosine double")
    s = spark.createDataFrame([(n, *r) for n, r in enumerate(sets)], f"set long, id {kind}, items array<long>")
    for stripe, cell, round_bytes, looked_up in ((overlap.STRIPE_BYTES, overlap.CELL_PAIRS, overlap.ROUND_BYTES, overlap.LOOKED_UP), (3000, 100, 1, 7)):
        for name, v in (("STRIPE_BYTES", stripe), ("CELL_PAIRS", cell), ("ROUND_BYTES", round_bytes)):
            monkeypatch.setattr(overlap, name, v)
        for most in (0.2, 1.0):
            got = sorted((r.a, r.b, r.cosine, round(r.jaccard, 9)) for r in overlap.jaccards(p, s, most).collect())
            assert got == brute(pairs, sets, most)
        monkeypatch.undo()
    assert overlap.jaccards(p.limit(0), s.limit(0), 1.0).count() == 0


def test_intersections_in_parts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 50, n)) for n in (0, 1, 5, 40, 90, 0, 200)]
    start = np.r_[0, np.cumsum([len(s) for s in sets])]
    u, v = (x.ravel() for x in np.meshgrid(np.arange(7), np.arange(7)))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(u, v)]
    for most in (1, 9, 1 << 20):
        assert overlap.intersections(start, np.concatenate(sets), u, v, most).tolist() == want
    assert overlap.intersections(start, np.concatenate(sets), u[:0], v[:0]).tolist() == []


def written_bytes(spark):
    """Bytes that all stages so far wrote to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_contradictions_send_no_text_once_a_pair(spark):
    """All 19,900 pairs of 200 texts of 400 3-grams, half of them shared: a set for each pair would be 64 MB."""
    words = lambda i: " ".join([f"w{k}" for k in range(200)] + [f"t{i}x{k}" for k in range(200)])
    texts = spark.createDataFrame([(i, words(i)) for i in range(200)], "id long, text string")
    band = texts.select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    as_large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "200"}  # else one text's pairs follow one another, compressed
    before = {k: spark.conf.get(k) for k in as_large}
    for k, v in as_large.items():
        spark.conf.set(k, v)
    try:
        start = written_bytes(spark)
        got = corpus.contradictions(band, texts, 0.9, 0.9, None).select("a", "b", F.round("jaccard", 9).alias("j")).collect()
        sent = written_bytes(spark) - start
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 19_900 and {r.j for r in got} == {round(198 / 598, 9)}
    assert 0 < sent < 10 << 20, sent
