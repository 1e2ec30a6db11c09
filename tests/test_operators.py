"""Operators: laws, planted cases and gates."""

import hashlib
import tracemalloc
import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrove.functions.encode import hashed_encoder
from veritrove.operators import corpus, deep_search, incremental, memory, optimise, search, simjoin
from veritrove.operators.cluster import components
from veritrove.sources import files
from veritrove.sources import model as M
from veritrove.streaming import watch


def vectors(spark, x, first=0):
    x = np.asarray(x, float)
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")


def unit(n, d=16, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_block_joins_equal_brute_force(spark):
    x, y = unit(57), unit(41, seed=1)
    a, b = vectors(spark, x), vectors(spark, y)
    dots = x @ y.T
    want = {(i, j) for i in range(57) for j in range(41) if dots[i, j] >= 0.3}
    assert {(r.a, r.b) for r in simjoin.pairs(a, b, 0.3, block=16).collect()} == want
    own = x @ x.T
    want = {(i, j) for i in range(57) for j in range(i + 1, 57) if own[i, j] >= 0.3}
    got = simjoin.self_pairs(a, 0.3, block=16).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    near = {(r.a, r["rank"]): r.b for r in simjoin.nearest(a, b, 3, block=16).collect()}
    assert all([near[i, k + 1] for k in range(3)] == list(np.argsort(-dots[i], kind="stable")[:3]) for i in range(57))
    best = {r.id: r.cosine for r in simjoin.best_cosine(a, b, block=16).collect()}
    assert all(best[i] == pytest.approx(dots[i].max()) for i in range(57))


def test_empty_sides(spark):
    a, none = vectors(spark, unit(5)), vectors(spark, unit(5)).limit(0)
    assert corpus.unique(a, none).count() == 5
    assert simjoin.pairs(a, none, 0.1).count() == 0
    assert {r.bucket for r in corpus.corpus_diff(none, a).collect()} == {"added"}


def test_laws(spark):
    a = vectors(spark, unit(20))
    assert corpus.unique(a, a).count() == 0
    assert corpus.intersect(a, a, 0.999).count() >= 20
    assert {r.bucket for r in corpus.corpus_diff(a, a).collect()} == {"unchanged"}
    assert corpus.merge(a, a).count() == 20
    c = corpus.compare(a, a, None).first()
    assert c.overlap == pytest.approx(1) and c.centroid_cosine == pytest.approx(1)


def test_clusters_are_transitive(spark):
    v = vectors(spark, [(1, 0), (0.97, 0.243), (0.883, 0.468)])
    rows = corpus.near_duplicates(v, 0.95).collect()
    assert {r.cluster_id for r in rows} == {0} and len(rows) == 3
    x = np.array([(1, 0), (0.97, 0.243), (0.883, 0.468)])
    assert rows[0].mean_cosine == pytest.approx(np.mean([x[0] @ x[1], x[0] @ x[2], x[1] @ x[2]]))


def test_components_by_rounds_and_at_once(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (None, 7), (5, 5)]
    df = spark.createDataFrame(e, "src long, dst long")
    got = {tuple(r) for r in components(df).collect()}
    assert got == {tuple(r) for r in components(df, local_edges=0).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}


def test_top_k(spark):
    v = vectors(spark, [(1, 0), (1, 0), (0, 1), (0.6, 0.8)]).withColumn("f", F.col("id") % 2)
    assert [r.id for r in search.top_k(v, [1, 0], 3).collect()] == [0, 1, 3]
    assert [r.id for r in search.top_k(v, [1, 0], 3, ["f"]).collect()] == [0, 1]
    assert search.top_k(v, [1, 0], 0).count() == 0
    every = search.top_k_all(v.select("id", "vec"), v.where("id <> 1").select("id", "vec"), 3).orderBy("query_id", "rank").collect()
    for q in v.where("id <> 1").collect():
        alone = [(r.id, pytest.approx(r.score)) for r in search.top_k(v, list(q.vec), 3).collect()]
        assert [(r.id, r.score) for r in every if r.query_id == q.id] == alone
    assert search.top_k_all(v.select("id", "vec"), v.select("id", "vec"), 0).count() == 0


def test_budget(spark):
    r = spark.createDataFrame([(i, n) for i, n in enumerate((50, 10, 5, 100, 1))], "k int, n int")
    assert [x.k for x in search.budget_cut(r, F.col("n"), 30, ["k"]).collect()] == [0]
    assert search.budget_cut(r, F.col("n"), 30, ["k"], first_always=False).count() == 0
    assert [x.k for x in search.budget_cut(r, F.col("n"), 66, ["k"]).collect()] == [0, 1, 2]


def planted(spark, cosines, **more):
    rows = [(f"r{i}", [c, float(np.sqrt(1 - c * c))], more.get("rec", {}).get(i, 5), i in more.get("bad", ()), ["prefer", more.get("scope", {}).get(i, "cross-workspace")]) for i, c in enumerate(cosines)]
    return spark.createDataFrame(rows, "row_id string, vec array<double>, recurrence_count int, is_bad boolean, polarity array<string>")


def test_recall_gates(spark):
    ids = lambda rows, **k: [r.row_id for r in memory.recall(rows, [1.0, 0.0], "workspace:a", **k).collect()]
    assert ids(planted(spark, [0.95, 0.85, 0.75, 0.69])) == ["r0", "r1", "r2"]
    assert ids(planted(spark, [0.95, 0.85], bad={0})) == ["r1"]
    assert ids(planted(spark, [0.95, 0.85], scope={0: "workspace:b", 1: "workspace:a"})) == ["r1"]
    assert ids(planted(spark, [0.95, 0.94]), gap=0.05) == []
    assert ids(planted(spark, [0.95, 0.94], rec={1: 1}), gap=0.05) == []  # the gap comes before recurrence
    assert ids(planted(spark, [0.95]), gap=0.05) == ["r0"]
    assert ids(planted(spark, [0.95, 0.8], rec={0: 1})) == ["r1"]


def test_gc_refuses_everything(spark):
    with pytest.raises(ValueError):
        memory.gc_doomed(planted(spark, [0.9]))


def test_votes(spark):
    rows = planted(spark, [0.9, 0.8]).withColumn("last_corroborated_at", F.lit(""))
    r = {x.row_id: x for x in memory.vote(memory.vote(rows, "r0", "bad", ""), "r1", "corroborate", "2024").collect()}
    assert r["r0"].is_bad and r["r1"].recurrence_count == 6 and r["r1"].last_corroborated_at == "2024"


def test_lessons_and_journal():
    reply = 'Here: [{"text": "Use tabs", "polarity": ["prefer", "workspace:{workspace_hash}"]}, {"text": "", "polarity": ["prefer"]}, {"text": "x", "polarity": []}]'
    assert memory.lessons(reply, "abc") == [{"text": "Use tabs", "polarity": ["prefer", "workspace:abc"], "intent": ""}]
    assert memory.lessons("no list", "abc") == [] and memory.lessons("[broken", "abc") == []
    seen = set()
    captures = [{"row_id": "1", "text": "t", "transcript_hash": "h"}]
    ask = lambda *a: (reply, 1, 1)
    assert len(memory.distil(captures, "abc", ask, lambda t: False, seen)) == 1
    assert memory.distil(captures, "abc", ask, lambda t: False, seen) == []
    assert len(memory.ulid()) == 26


def test_injection_block_keeps_rows_whole():
    rows = [{"polarity": ["prefer"], "text": "x" * 50}, {"polarity": ["avoid"], "text": "y" * 50}]
    assert memory.injection_block(rows, 80).count("\n") == 0 and memory.injection_block(rows, 10) == ""


def test_capture(spark):
    m = [(1, 0, "user", "please do this long and real thing", 1), (1, 1, "assistant", "z" * 190 + " " + "0" * 40, 0), (1, 2, "assistant", "more " * 10, 0), (2, 0, "user", "hi", 0), (2, 1, "assistant", "short", 0)]
    df = spark.createDataFrame(m, "conv_id long, turn long, role string, text string, n_tools int")
    gate = {r.conv_id: r.reason for r in memory.capture_gate(df).collect()}
    assert gate == {1: "", 2: "short_assistant"}
    row = memory.captured(df, "workspace:x", "2024-01-01T00:00:00Z").collect()
    assert len(row) == 1 and "<REDACTED>" in row[0].text and len(row[0].transcript_hash) == 64
    sha = lambda parts: hashlib.sha256("".join(p + "\0" for p in parts).encode()).hexdigest()
    assert row[0].transcript_hash == sha([p for x in m[:3] for p in x[2:4]])
    tools = F.when(F.col("turn") == 1, F.array(F.struct(F.lit("bash").alias("name"), F.lit(None).cast("string").alias("path"), F.lit("ls").alias("content"))))
    with_tools = memory.captured(df.withColumn("tools", tools).withColumn("session_id", F.lit("s1")), "workspace:x", "").collect()[0]
    assert with_tools.transcript_hash == sha(["s1", *m[0][2:4], *m[1][2:4], "bash", "", "ls", *m[2][2:4]])


def test_capture_of_long_conversations(spark):
    """A conversation far longer than what is kept of it, among short ones, whatever order its rows come in."""
    n = 30_000
    long = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("message "), "id").alias("text"))
    df = long.select("conv_id", F.col("id").alias("turn"), "role", "text", F.lit(0).alias("n_tools")).union(spark.createDataFrame([(8, 0, "assistant", "x" * 300, 0), (8, 1, "user", "y" * 40, 0)], "conv_id long, turn long, role string, text string, n_tools int"))
    got = {r.conv_id: r for r in memory.captured(df.orderBy(F.rand(3)), "w", "", most_chars=100).collect()}
    h = hashlib.sha256()
    for k in range(n):
        h.update(f"{('user', 'assistant')[k % 2]}\0message {k}\0".encode())
    assert got[7].transcript_hash == h.hexdigest() and got[7].text == "\n\n".join(f"message {k}" for k in range(1, 40, 2))[:100] and len(got[8].text) == 100


def test_lessons_and_votes(spark):
    reply = 'As in [1] and [see: x]: [{"text": " Use it. ", "polarity": ["prefer", "workspace:{workspace_hash}"]}, {"text": "b", "polarity": ["none"]}]'
    assert memory.lessons(reply, "abc") == [{"text": "Use it.", "polarity": ["prefer", "workspace:abc"], "intent": ""}]
    assert memory.lessons("none", "a") == [] and memory.lessons("[", "a") == [] and memory.lessons("[1] []", "a") == []
    rows = spark.createDataFrame([(f"r{k}", False, 1, "then") for k in range(4)], "row_id string, is_bad boolean, recurrence_count int, last_corroborated_at string")
    votes = spark.createDataFrame([(1, "r0", "bad"), (2, "r0", "good"), (3, "r1", "good"), (4, "r1", "bad"), (5, "r2", "corroborate"), (6, "r2", "corroborate"), (7, "r9", "bad")], "n int, row_id string, kind string")
    got = {r.row_id: tuple(r)[1:] for r in memory.voted(rows, votes, "now").collect()}
    assert got == {"r0": (False, 1, "then"), "r1": (True, 1, "then"), "r2": (False, 3, "now"), "r3": (False, 1, "then")}
    with pytest.raises(Exception):
        memory.voted(rows, votes.withColumn("kind", F.lit("worse")), "").collect()


def test_model_round_trip_and_refresh(spark, tmp_path):
    make = lambda: hashed_encoder(32)
    src = {"a.md": "Alpha beta. " * 30, "b.md": "Gamma delta. " * 40, "c.md": "Rho. " * 60}
    df = lambda s: spark.createDataFrame(list(s.items()), "source_file string, text string")
    m = M.build(df(src), make)
    M.save(m, str(tmp_path / "m"))
    m = M.load(spark, str(tmp_path / "m"))
    assert m.dim == 32 and m.passages.count() == m.base.count() == 3
    same, counts = M.refreshed(m, df(src), make)
    assert same is m and counts == {"unchanged": 3}
    new = {**src, "b.md": src["b.md"].replace("Gamma", "Gamna"), "d.md": "Tau. " * 70}
    del new["a.md"]
    r, counts = M.refreshed(m, df(new), make)
    assert counts == {"unchanged": 1, "updated": 1, "removed": 1, "added": 1}
    M.check(r)
    skipped = spark.createDataFrame([("a.md", "decode")], "source_file string, reason string")
    _, counts = M.refreshed(m, df(new), make, skipped)
    assert counts["unchanged"] == 2
    with pytest.raises(ValueError):
        M.converted(m, df(new))
    assert M.converted(m, df(src)).passages.count() == 3
    hits, conf = corpus.evidence(m, df(src), list(map(float, make()(["Alpha beta."])[0])), 2)
    assert hits.orderBy(F.desc("score")).first().source_file == "a.md" and conf.first().drift_fraction == 0


def test_manifests(spark):
    m = lambda rows: spark.createDataFrame(rows, "source_file string, url string, sha256 string")
    d = incremental.manifest_diff(m([("a", "u", "1"), ("b", "u", "1"), ("c", "u", "1")]), m([("a", "u", "1"), ("b", "v", "1"), ("d", "u", "1")]))
    assert {(r.source_file, r.bucket) for r in d.collect()} == {("a", "unchanged"), ("b", "modified"), ("c", "removed"), ("d", "added")}

    def opener(url):
        if url == "gone":
            raise OSError("no")
        return b"x\r\ny"

    f = {r.source_file: r for r in files.fetched(m([("a", "u", "0"), ("b", "gone", "0")]), opener).collect()}
    assert f["a"].text == "x\ny" and not f["a"].ok and f["b"].text is None


def test_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("é\r\nb")
    (tmp_path / "docs" / "b.md").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "docs" / "c.bin").write_text("no")
    good, bad = files.walk(spark, files.detect_sources(str(tmp_path)), str(tmp_path))
    assert [tuple(r) for r in good.collect()] == [("docs/a.md", "é\nb")] and [tuple(r) for r in bad.collect()] == [("docs/b.md", "decode")]
    with pytest.raises(Exception):
        files.guarded(spark.createDataFrame([("../x", "t")], "source_file string, text string")).collect()


def test_watch_sees_edits_and_removals(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.md").write_text("1")
    (folder / "b.md").write_text("1")
    seen = []

    def run():
        watch.on_change(spark, str(folder), str(tmp_path / "ck"), lambda df, k: seen.extend(map(tuple, df.collect())), once=True).awaitTermination()

    run()
    assert sorted(seen) == [("a.md", "added"), ("b.md", "added")]
    seen.clear()
    run()
    assert seen == []
    (folder / "a.md").write_text("22")
    (folder / "b.md").unlink()
    (folder / "c.md").write_text("3")
    run()
    assert sorted(seen) == [("a.md", "changed"), ("b.md", "removed"), ("c.md", "added")]


def test_negatives_and_filter(spark):
    v = vectors(spark, unit(6))
    h = optimise.hard_negatives(v, v, v.select(F.col("id").alias("a"), F.col("id").alias("b")), pool=4, take=7).collect()
    assert len(h) == 42 and all(r.a != r.b for r in h)
    assert optimise.good_query("what is the plan?") and not optimise.good_query("This passage says")


def test_deep_search():
    replies = iter(["plan q", '{"action": "search", "query": "two"}', 'so {"action": "answer", "answer": "42"}'])
    hits = lambda q: [{"source_file": q, "char_offset": 0, "text": q}]
    r = deep_search.deep_search("q?", hits, lambda *a: (next(replies), 1, 2))
    assert r.answer == "42" and len(r.passages) == 2 and r.tokens == 9
    assert deep_search.action_of("none") == {} and deep_search.action_of('{"a": 1} {"action": "x"}') == {"action": "x"}


def test_context_names(spark):
    hit = {"source_file": "a", "char_offset": 0, "char_length": 3, "score": 0.9, "drift_status": "verified", "text": "about MLV"}
    text, missing = search.context([hit], {"top1_score": 0.9, "drift_fraction": 0.0}, "What is MVE?")
    assert missing == ["MVE"] and "Name check failed" in text
    text, _ = search.context([hit], {"top1_score": 0.1, "drift_fraction": 0.0}, "x")
    assert "no confident evidence" in text


def test_memory_mutations(spark, tmp_path):
    rows = planted(spark, [0.9, 0.8]).withColumns({"last_corroborated_at": F.lit("a"), "created_at": F.lit("2024"), "transcript_hash": F.col("row_id")})
    rows = rows.withColumn("polarity", F.array(F.lit("factual")))
    more = memory.corroborated(rows, spark.createDataFrame([("r1",), ("r1",)], "row_id string"), "b")
    got = {r.row_id: (r.recurrence_count, r.last_corroborated_at) for r in more.collect()}
    assert got == {"r0": (5, "a"), "r1": (7, "b")}
    with pytest.raises(Exception):
        memory.add_rows(rows, rows.withColumn("polarity", F.array(F.lit("x")))).collect()
    assert memory.add_rows(rows, rows).count() == 4
    memory.append_log(rows.where("row_id = 'r0'").select("row_id", "transcript_hash"), str(tmp_path / "j"))
    assert [r.row_id for r in memory.unseen(rows, spark.read.json(str(tmp_path / "j"))).collect()] == ["r1"]
    assert memory.latest_capture(rows).first()[0] == "r1"
    assert memory.delete_rows(rows, memory.gc_doomed(rows, most_recurrence=9)).count() == 0


def test_json_hits(spark):
    df = spark.createDataFrame([(0, "a", 0, 1, 0.5, "verified", "x"), (1, "b", 0, 1, 0.9, "drifted", None)], "passage_idx long, source_file string, char_offset int, char_length int, score double, drift_status string, text string")
    assert [r.json[:18] for r in search.as_json(df).collect()] == ['{"source_file":"b"', '{"source_file":"a"']
    assert search.as_text(df.collect()).count("\n") == 1


def test_approximate_search_reaches_its_recall(spark):
    from veritrove.plans.catalogue import QUERIES, band

    d = "/root/testdata/sf0.01"
    got = {(r.a, r.b) for r in QUERIES["ann_search"](spark, d).collect()}
    v = band(spark, d).select("id", "vec")
    want = {(r.a, r.b) for r in simjoin.nearest(v.where("id % 20 = 0"), v, 10).collect()}
    assert {a for a, _ in got} == {a for a, _ in want} and len(got & want) >= 0.9 * len(want)


def test_models_keep_their_chunk_bounds(spark, tmp_path):
    make = lambda: hashed_encoder(16)
    src = {"a.md": "\n\n".join(f"Paragraph {k} says a few words. " * 3 for k in range(9)), "b.md": "\n\n".join(f"Another {k} is here too. " * 4 for k in range(7))}
    df = lambda s: spark.createDataFrame(list(s.items()), "source_file string, text string")
    path = str(tmp_path / "m")
    M.save(M.build(df(src), make, least=20, most=400), path)
    M.save(M.load(spark, path), path)  # CURRENT is replaced in one step
    m = M.load(spark, path)
    n = m.passages.count()
    same, counts = M.refreshed(m, df(src), make)
    assert same is m and counts == {"unchanged": n}
    new, counts = M.refreshed(m, df({**src, "b.md": src["b.md"] + "\n\nOne more paragraph at the end."}), make)
    assert counts["unchanged"] >= n - 1 and M.build_bounds(new) == (20, 400)
    assert M.build_bounds(m, most=99) == (20, 99) and M.build_bounds(M.Model(m.passages, m.bands)) == (200, 3200)


def test_federated_models_must_fit(spark):
    v = vectors(spark, unit(6)).withColumnRenamed("id", "passage_idx")
    model = lambda dim, revision: M.Model(v, {"base": v}, {"dim": dim, "revision": revision})
    hits, odd = corpus.compose_models({"a": model(16, "r1"), "b": model(16, "r2"), "c": model(16, "r1")}, [1.0] * 16, 4)
    assert odd == ["b"] and hits.count() == 4
    with pytest.raises(ValueError):
        corpus.compose_models({"a": model(16, "r"), "b": model(8, "r")}, [1.0] * 16)


def test_walk_lists_only_suffixes(spark, tmp_path):
    for name in ("a.md", "B.MD", "c.bin", "d.py", "e.md.png"):
        (tmp_path / name).write_bytes(b"\xff\xfe\x00" if name.endswith("bin") else b"text")
    good, bad = files.walk(spark, [str(tmp_path)], str(tmp_path))
    assert {r.source_file for r in good.collect()} == {"a.md", "B.MD", "d.py"} and bad.count() == 0


def test_migration_needs_an_empty_target(spark):
    e = spark.createDataFrame([("use it", "working", "", 1)], "text string, tier string, created_utc string, recurrence_count int")
    rows = memory.checked_migration(e, e.limit(0), "workspace:x")
    assert rows.count() == 1
    with pytest.raises(ValueError):
        memory.checked_migration(e, rows, "workspace:x")


def test_grid_of_stripes():
    g, h = simjoin.grid_of(10**8, 10**8, 64, 8)
    assert simjoin.STRIPE_BYTES // (8 * 64) >= 10**8 / g and g == h
    assert simjoin.grid_of(500, 500, 64, 8) == (1, 1) and simjoin.grid_of(0, 0, 1, 8) == (1, 1)
    assert retention_and_time() == (0.5, 0.0, 17.0)


def retention_and_time():
    return optimise.retention(3, 6), optimise.retention(0, 0), optimise.estimate_seconds(20)


def test_best_of_blocks_sorts_only_what_can_be_among_the_best(monkeypatch):
    """Ties and bounds as by sorting whole rows; later blocks leave few values to sort."""
    rng = np.random.default_rng(4)
    full = rng.integers(-9, 10, (30, 70)).astype(float)
    low = np.sort(full, 1)[:, -5]
    for bound in (None, low):
        best, at = np.full((30, 5), -np.inf), np.full((30, 5), -1)
        for t in range(0, 70, 16):
            simjoin.best_of(full[:, t : t + 16].copy(), t, best, at, bound)
        assert (at == np.argsort(-full, axis=1, kind="stable")[:, :5]).all()
    cells, real = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: cells.append(x.size) or real(x, *a, **k))
    x, best, at = rng.normal(size=(64, 8192)), np.full((64, 5), -np.inf), np.full((64, 5), -1)
    for t in range(0, 8192, 1024):
        simjoin.best_of(x[:, t : t + 1024], t, best, at)
    assert sum(cells) < x.size / 20


def test_ann_search_holds_few_dot_products_at_once():
    """A part of a cell is multiplied in small blocks, with the same result."""
    from veritrove.operators import ann

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(4096, 8)), rng.normal(size=(8192, 8))
    tracemalloc.start()
    best, at = ann.best_rows(x, y, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    want = np.argsort(-(x[:200] @ y.T), axis=1, kind="stable")[:, :10]
    assert (at[:200] == want).all() and np.allclose(best[:200], np.take_along_axis(x[:200] @ y.T, want, 1))
    best, at = ann.best_rows(x[:3], y[:4], 10)
    assert np.isfinite(best).sum(1).tolist() == [4, 4, 4]
