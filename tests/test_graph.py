"""Graph index: its parts against brute force, recall, round trip, checks, dispatch."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrove.operators import graph, simjoin


def clustered(n, d, seed, spread=0.35):
    rng = np.random.default_rng(seed)
    centers = np.random.default_rng(77).normal(size=(20, d))
    x = centers[rng.integers(0, 20, n)] / np.sqrt(d) + spread * rng.normal(size=(n, d)) / np.sqrt(d)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<float>")


def test_near_rows_and_links():
    x = clustered(300, 8, 1)
    at, dots = graph.near_rows(x, 12, 64)
    d = x @ x.T
    np.fill_diagonal(d, -np.inf)
    assert np.allclose(dots, -np.sort(-d, axis=1)[:, :12], atol=1e-6) and np.allclose(np.take_along_axis(d, at.astype(int), 1), dots)
    keep = graph.spread_links(x, at, dots, 5, 128)
    for i in range(300):  # by the definition
        kept = []
        for j in range(12):
            stays = len(kept) < 5 and all(x[at[i, j]] @ x[c] <= dots[i, j] for c in kept)
            assert stays == keep[i, j]
            kept += [at[i, j]] if stays else []
    links = graph.linked(x, 16)
    assert links.shape == (300, 16) and (links[:, :13] != np.arange(300)[:, None]).all() and links.max() < 300
    assert graph.linked(x[:1], 16).max() == -1 and graph.linked(x[:0], 16).shape == (0, 16)


def test_links_are_chosen_in_blocks():
    """The same links whatever the block, in little more memory than near rows and links take."""
    x = np.concatenate([clustered(700, 8, 10), np.repeat(clustered(3, 8, 11), 60, 0)])
    links = graph.linked(x, 16)
    for block in (1, 97, 880):
        assert (graph.linked(x, 16, block=block) == links).all()
    x = clustered(6000, 16, 12)
    tracemalloc.start()
    links = graph.linked(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 * links.nbytes


@pytest.mark.parametrize("x", [clustered(3000, 16, 2), np.repeat(clustered(40, 8, 3), 30, 0), clustered(7, 4, 4)])
def test_beam_search_recall(x):
    q = clustered(60, x.shape[1], 5)
    at, best = graph.beam_search(x, graph.linked(x), q, 10, 96)
    exact = -np.sort(-(q @ x.T), axis=1)[:, :10]
    n = exact.shape[1]
    assert (np.isclose(best[:, :n], exact, atol=1e-5)).mean() >= 0.97  # by value, as copies tie
    assert ((at >= 0).sum(1) == n).all() and all(len(set(r[:n])) == n for r in at)


def test_search_over_shards_and_round_trip(spark, tmp_path):
    x = clustered(2400, 24, 6)
    band, queries = frame(spark, x), frame(spark, clustered(90, 24, 7), 10_000)
    index = graph.build(band, shard_rows=700)
    path = str(tmp_path / "graph")
    graph.save(index, path)
    loaded = graph.load(spark, path, 2400, 24)
    assert loaded.count() == 4
    exact = simjoin.nearest(queries, band, 10)
    found = graph.search(loaded, queries, 10, query_rows=40)
    assert graph.recall(found, exact) >= 0.95
    cosine = {(r.a, r.b): r.cosine for r in exact.collect()}
    rows = found.collect()
    assert all(abs(cosine[r.a, r.b] - r.cosine) < 1e-6 for r in rows if (r.a, r.b) in cosine)
    assert sorted((r.a, r["rank"]) for r in rows) == [(10_000 + a, k) for a in range(90) for k in range(1, 11)]
    for rows, dim in ((2399, 24), (2400, 23)):
        with pytest.raises(ValueError):
            graph.load(spark, path, rows, dim)
    edges = graph.links_of(loaded)
    assert edges.select("id").distinct().count() == 2400 and edges.where("id = link").count() < 300


def test_dispatch_and_odd_rows(spark, monkeypatch):
    x = clustered(120, 8, 8)
    band, queries = frame(spark, x), frame(spark, x[:9])
    assert graph.index_of(band) is None and graph.worth_building(5001) and not graph.worth_building(5000)
    exact = {(r.a, r.b) for r in graph.retrieve(queries, band, k=3).collect()}
    monkeypatch.setattr(graph, "LEAST_ROWS", 100)
    index = graph.index_of(band)
    assert {(r.a, r.b) for r in graph.retrieve(queries, band, index, k=3).collect()} == exact
    w = np.eye(8)[:4]
    small = simjoin.project_band(band, w)
    got = graph.retrieve(queries, small, graph.build(small), w, 1).collect()
    assert {(r.a, r.b) for r in got} == {(i, i) for i in range(9)}
    odd = band.union(spark.createDataFrame([(None, [1.0] * 8), (7_000, None)], band.schema))
    assert graph.build(odd).agg(F.sum(F.size("ids"))).first()[0] == 120
    empty = graph.build(band.limit(0))
    assert graph.search(empty, queries, 3).count() == 0 and graph.search(index, queries.limit(0), 3).count() == 0
    graph.check(empty, 0, 8)


def test_retrieve_by_size_is_its_sql(spark, tmp_path, monkeypatch):
    """The query by graphs, which miss some rows of vectors that don't cluster, against the SQL; copies tie."""
    import duckdb

    import __spark_entry__ as entry

    x = np.random.default_rng(13).normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[2900:] = x[:100]
    frame(spark, x).select(F.col("id").alias("vec_id"), F.col("vec").alias("embedding"), F.lit(0).alias("label")).write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(graph, "LEAST_ROWS", 1000)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["retrieve_by_size"]).fetchall()
    got = [tuple(r) for r in entry.queries()["retrieve_by_size"](spark, str(tmp_path)).collect()]
    assert len(got) == 1500 and sorted(got) == sorted(want)


def test_completed_whatever_was_found(spark):
    """Few, wrong or no rows found, long queries and vectors of doubles: the k nearest all the same."""
    x = clustered(400, 8, 14).astype(float)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    band = spark.createDataFrame(rows, "id long, vec array<double>")
    queries = spark.createDataFrame([(i, [37 * v for v in r]) for i, r in rows[:30]], band.schema)
    want = sorted((r.a, r.b, r["rank"]) for r in simjoin.nearest(queries, band, 4).collect())
    dots = 37 * x[:30] @ x.T
    for n in (0, 4, 400):  # found among so many of the rows
        near = np.argsort(-dots[:, :n], axis=1)[:, :4]
        found = spark.createDataFrame([(a, int(b), float(dots[a, b]), k + 1) for a in range(25) for k, b in enumerate(near[a])], "a long, b long, cosine double, rank long")
        assert sorted((r.a, r.b, r["rank"]) for r in graph.completed(found, queries, band, 4).collect()) == want


def test_model_with_graphs(spark, tmp_path, monkeypatch):
    from veritrove.sources import model as M

    x = clustered(150, 8, 9)
    passages = spark.range(150).select(F.col("id").alias("passage_idx"), F.lit("f").alias("source_file"), F.lit(0).alias("char_offset"), F.lit(0).alias("char_length"), F.lit("h").alias("content_hash"), F.col("id").cast("string").alias("passage_id"))
    m = M.Model(passages, {"base": frame(spark, x).withColumnRenamed("id", "passage_idx")})
    w = np.eye(8)[:4]
    m = M.with_band(m, "optimised", simjoin.project_band(frame(spark, x), w).withColumnRenamed("id", "passage_idx"), w)
    assert M.indexed(m).graphs == {}
    monkeypatch.setattr(graph, "LEAST_ROWS", 100)
    path = str(tmp_path / "m")
    M.save(M.indexed(m), path)
    again = M.load(spark, path)
    assert sorted(again.graphs) == ["base", "optimised"]
    queries = frame(spark, x[:12])
    for band in ("base", "optimised"):
        exact = {(r.a, r.b) for r in M.retrieve(m, queries, 3, band).collect()}
        assert {(r.a, r.b) for r in M.retrieve(again, queries, 3, band).collect()} == exact
    assert M.with_band(again, "base", again.base).graphs.keys() == {"optimised"}  # a new band has no graph yet
    snap = next(p for p in (tmp_path / "m").iterdir() if p.is_dir())
    spark.read.parquet(f"{snap}/graphs/base").select("shard", "dim", F.slice("ids", 1, 149).alias("ids"), "vecs", "links").write.parquet(f"{snap}/bad")
    (snap / "graphs/base").rename(snap / "graphs/old")
    (snap / "bad").rename(snap / "graphs/base")
    with pytest.raises(ValueError):
        M.load(spark, path)
