"""The pipeline against the brute-force versions of its stages, one after the other."""

from collections import Counter

import numpy as np
from test_text_operators import WORD, brute_components, brute_quality, frame, lower, near_copies, prose

import corpus_pipeline
from veritrove.llm import queries


def corpus(rng):
    items = [prose(rng, n, 5000) for n in (12, 30, 70)]
    texts = near_copies(rng, 80)
    texts += [None, "", "short", "same words " * 60]
    texts += [f"{prose(rng, 60, 5000)}\nA line that is everywhere.\n{prose(rng, 40, 5000)}" for _ in range(30)]
    texts += [f"{prose(rng, 60, 5000)} {items[k % 3]} {prose(rng, 30, 5000)}" for k in range(6)]
    return texts, items


def brute(texts, sources, items):
    docs = {k: t for k, t in enumerate(texts)}
    docs = {k: t for k, t in docs.items() if not brute_quality(t)[-1]}  # no host fails as a whole here
    yield "quality", dict(docs)
    spread, first = {}, {}
    for k in sorted(docs):
        for x in docs[k].split("\n"):
            if WORD.search(x):
                spread.setdefault(x, set()).add(sources[k])
                first.setdefault(x, k)
    gone = {x for x, s in spread.items() if len(s) >= 8}
    for k in list(docs):
        kept = [x for x in docs[k].split("\n") if x not in gone or first[x] == k]
        docs[k] = "\n".join(kept)
        if not WORD.search(docs[k]):
            del docs[k]
    yield "lines", dict(docs)
    top = brute_components(sorted(docs.items()))
    docs = {k: t for k, t in docs.items() if top[k] == k}
    yield "near_duplicates", dict(docs)
    docs = {k: t for k, t in docs.items() if not any(x in t for x in items)}
    yield "leaks", dict(docs)


def test_stages_and_run(spark, tmp_path):
    texts, items = corpus(np.random.default_rng(21))
    sources = [f"s{k % 12}" for k in range(len(texts))]
    d = str(tmp_path)
    frame(spark, texts, sources).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    want = dict(brute(texts, sources, items))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, d).write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        rows = docs.collect()
        assert docs.columns == columns and {r.doc_id: r.text for r in rows} == want[name], name
        assert all(r.q == "q" and r._drop == "d" for r in rows)
    rows = corpus_pipeline.run(spark, d).collect()
    n = Counter()
    for r in rows:
        n[r.doc_id] += r.n_tokens
    assert n == {k: len(WORD.findall(lower(t))) for k, t in want["leaks"].items()}


def test_stages_take_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    empty = frame(spark, ["x"]).limit(0)
    spark.createDataFrame([(0, "a b c")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0


def test_every_operator_has_a_query():
    assert [q.split("_")[0] for q in queries.QUERIES if q.startswith("op")] == [f"op{n}" for n in range(1, 14)]
