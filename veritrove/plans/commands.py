"""The command surface as functions: each returns its text and an exit code.

0 all is well, 1 wrong use, 2 drift or unavailable sources, 3 names missing
under strict_names, 4 training stopped early. Encoders, openers and language
models are passed in."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrove.functions.encode import Encoder, encoded
from veritrove.operators import corpus, incremental, optimise, search, synthesis, training
from veritrove.operators.deep_search import Result, deep_search
from veritrove.operators.simjoin import project_band
from veritrove.plans.session import written
from veritrove.sources import files
from veritrove.sources import model as M
from veritrove.sources.remote import Feed, TextCache

Make = Callable[[], Encoder]


def _query(make: Make, question: str) -> list[float]:
    return [float(x) for x in np.asarray(make()([question])[0])]


def build(spark: SparkSession, paths: list[str], out: str, make: Make, revision: str = "hashed") -> tuple[str, int]:
    good, bad = files.walk(spark, paths, files.common_root(paths))
    m = M.build(good, make, revision)
    if m.passages.isEmpty():
        return "nothing to index", 1
    M.save(m, out)
    return f"{m.passages.count()} passages; skipped: {bad.count()}", 0


def _hits(m: M.Model, sources: DataFrame, make: Make, question: str, k: int):
    hits, conf = corpus.evidence(m, sources, _query(make, question), k)
    return hits.orderBy(F.desc("score"), "passage_idx").collect(), conf.first()


def find(m: M.Model, sources: DataFrame, make: Make, question: str, k: int = 10, mode: str = "augment", strict_names: bool = False, verified_only: bool = False) -> tuple[str, int]:
    hits, conf = _hits(m, sources, make, question, k)
    if verified_only:
        hits = [h for h in hits if h["drift_status"] == "verified"]
    text, missing = search.context(hits, conf, question, mode)
    return text, 3 if missing and strict_names else 0


def skill_context(m: M.Model, sources: DataFrame, make: Make, questions: list[str], k: int = 5, mode: str = "augment", tokens: int = 4_000, strict: bool = False) -> tuple[str, int]:
    """A block for each question until the budget is spent (the first always); a banner where hits have drifted."""
    out, used, drifted = [], 0, False
    for question in questions:
        hits, conf = _hits(m, sources, make, question, k)
        drifted |= any(h["drift_status"] != "verified" for h in hits)
        body, _ = search.context(hits, conf, question, mode)
        block = f"### {question}\n<!-- top1={conf['top1_score']:.3f} gap={conf['top1_top2_gap']:.3f} diversity={conf['source_diversity']:.2f} drift={conf['drift_fraction']:.2f} -->\n{body}"
        if out and used + len(block) > tokens * search.CHARS_PER_TOKEN:
            break
        out.append(block)
        used += len(block)
    banner = "> Some passages have drifted; refresh the model.\n\n" if drifted else ""
    return banner + "\n\n".join(out), 2 if strict and drifted else 0


def profile(m: M.Model, sources: DataFrame | None = None) -> tuple[str, int]:
    p = corpus.profile_of(m, sources)
    lines = [f"passages: {p.passages}", f"files: {p.source_files}", "bands: " + ", ".join(f"{k} ({d})" for k, d in sorted(p.bands.items())), f"encoder: {p.encoder or p.revision}", f"format: {p.format_version}"]
    lines += ["drift: skipped"] if sources is None else [f"{k}: {n}" for k, n in sorted(p.drift.items())]
    most = [f"  {r.source_file} ({r.n})" for r in p.files.orderBy(F.desc("n"), "source_file").limit(10).collect()]
    return "\n".join([*lines, "largest files:", *most]), 0


def compare(a: M.Model, b: M.Model, sample_size: int = 512) -> tuple[str, int]:
    try:
        corpus.check_pair(a, b)
    except ValueError as e:
        return str(e), 1
    ids = lambda m: m.base.select(F.col("passage_idx").alias("id"), "vec")
    return "\n".join(f"{k}: {v:.4f}" for k, v in corpus.compare(ids(a), ids(b), sample_size).first().asDict().items()), 0


def summary(m: M.Model, sources: DataFrame, make: Make, questions: list[str] | None = None) -> tuple[str, int]:
    """Landscape (nearest to the centroid), structure (files), evidence (for each question)."""
    c = list(corpus.centroid(m.base.select("vec")).first()["vec"])
    hits, _ = corpus.evidence(m, sources, c, 10, "base")
    rows = [h for h in hits.orderBy(F.desc("score"), "passage_idx").collect() if h["text"]]
    out, used = ["## Landscape"], 0
    for h in rows:
        line = f"- {h['source_file']}: {h['text'][:600]}"
        if used and used + len(line) > 600 * search.CHARS_PER_TOKEN:
            break
        out.append(line)
        used += len(line)
    out += ["## Structure", search.table_of_contents(m.passages)]
    if questions:
        out.append("## Evidence")
        share = max(200, 1_600 * search.CHARS_PER_TOKEN // len(questions))
        for q in questions:
            found, _ = _hits(m, sources, make, q, 5)
            out.append(f"### {q}\n" + "\n".join(f"- {h['source_file']}: {(h['text'] or '')[:400]}" for h in found)[:share])
    return "\n".join(out), 0


def refresh(spark: SparkSession, path: str, roots: list[str], make: Make, dry_run: bool = False) -> tuple[str, int]:
    m = M.load(spark, path)
    good, bad = files.walk(spark, roots, files.common_root(roots))
    new, counts = M.refreshed(m, good, make, bad)
    if new is not m and not dry_run:
        M.save(new, path)
    return ", ".join(f"{k}: {counts.get(k, 0)}" for k in ("unchanged", "updated", "added", "removed")), 0


def freshness(m: M.Model, opener: Callable[[str], bytes]) -> tuple[str, int]:
    if m.manifest is None:
        return "not a remote model", 1
    rows = incremental.freshness(m.manifest, files.fetched(m.manifest, opener).where("text is not null")).groupBy("status").count().orderBy("status").collect()
    return ", ".join(f"{r['status']}: {r['count']}" for r in rows), 2 if any(r["status"] != "verified" for r in rows) else 0


def sync(
    spark: SparkSession, path: str, opener: Callable[[str], bytes], make: Make, catalogue: DataFrame | None = None, allow_unavailable: bool = False, feed: Feed | None = None, cache: str | None = None
) -> tuple[str, int]:
    """Fetches what the manifest (or a new catalogue, or a feed's) names, refreshes by passage, and pins anew from the live bytes.

    A source that can't be fetched stops the run unless allowed; then its passages stay as they are. With a feed nothing is
    fetched while its head is that of the last run, and what it pins comes from the cache where that has it."""
    m = M.load(spark, path)
    if m.manifest is None:
        return "not a remote model", 1
    head = feed.head() if feed is not None else None
    if head is not None and head == m.metadata.get("head"):
        return "unchanged upstream", 0
    want = feed.catalogue() if feed is not None else catalogue if catalogue is not None else m.manifest
    texts = TextCache(spark, cache).texts(want, opener, strict=feed is not None) if cache is not None else files.fetched(want, opener)
    got = written(texts, "fetched")
    gone = got.where("text is null").select("source_file", F.lit("unavailable").alias("reason"))
    if not allow_unavailable and not gone.isEmpty():
        return f"unavailable: {gone.count()}", 2
    live = got.where("text is not null")
    new, counts = M.refreshed(m, live.select("source_file", "text"), make, gone)
    kept = m.manifest.join(live.select("source_file"), "source_file", "left_anti").join(gone.select("source_file"), "source_file", "left_semi")
    new.manifest = live.select("source_file", "url", "sha256").unionByName(kept.select("source_file", "url", "sha256"))
    if head is not None and gone.isEmpty():
        new.metadata = {**new.metadata, "head": head}
    M.save(new, path)
    return ", ".join(f"{k}: {counts.get(k, 0)}" for k in ("unchanged", "updated", "added", "removed")), 0


def convert(spark: SparkSession, path: str, out: str, sources: DataFrame, to: str, prefix: str = "") -> tuple[str, int]:
    """to: bundled, local or remote (with a url prefix)."""
    m = M.load(spark, path)
    try:
        made = M.converted(m, sources, to == "bundled", incremental.manifest(sources, prefix) if to == "remote" else None)
    except ValueError as e:
        return str(e), 2
    M.save(made, out)
    return to, 0


def optimise_band(
    spark: SparkSession, path: str, queries: DataFrame, make: Make, dims: tuple[int, ...] = training.DIMS, steps: int = training.STEPS, batch: int = training.BATCH, pool: int = 64
) -> tuple[str, int]:
    """Trains a projection on queries (passage_idx, query) against mined negatives, and writes the optimised band with its projection.

    Code 4: training was stopped as the first choice is right too seldom; 1: too few queries for a batch."""
    m = M.load(spark, path)
    band = m.base.select(F.col("passage_idx").alias("id"), "vec")
    kept = optimise.good_queries(queries.select("passage_idx", F.col("query").alias("q"))).distinct()
    asked = written(kept.select(F.xxhash64("passage_idx", "q").alias("id"), "passage_idx", encoded("q", make).alias("vec")), "queries")
    positives = asked.select(F.col("id").alias("a"), F.col("passage_idx").alias("b"))
    negatives = written(optimise.hard_negatives(asked.select("id", "vec"), band, positives, pool), "negatives")
    try:
        t = training.train(asked.select("id", "vec"), band, positives, negatives, dims, steps, batch)
    except ValueError as e:
        return str(e), 1
    if t.stopped == "dev":
        return f"stopped at step {t.steps}: the first choice is right in {t.dev_rate:.2f}", 4
    projected = project_band(band, t.w).withColumnRenamed("id", "passage_idx")
    M.save(M.with_band(m, "optimised", projected, t.w), path)
    return f"optimised: {len(t.w)} dimensions, loss {t.loss:.4f}, first choice {t.dev_rate:.2f}", 0


def optimise_model(
    spark: SparkSession, path: str, sources: DataFrame, make: Make, ask: Callable, cache: str, description: str = "a knowledge model", dims: tuple[int, ...] = training.DIMS,
    steps: int = training.STEPS, batch: int = training.BATCH, most: int = synthesis.MOST, estimate_only: bool = False,
) -> tuple[str, int]:
    """The whole way to an optimised band: queries for a sample of passages (resumable in the cache folder), their negatives, training, writing."""
    m = M.load(spark, path)
    if estimate_only:
        n = min(most, m.passages.count())
        return f"{n} queries, about ${optimise.estimate(n):.2f}, {optimise.estimate_seconds(n):.0f} s", 0
    texts = search.verified(m.passages, sources).where("drift_status = 'verified'").select("passage_idx", "source_file", "text")
    made = synthesis.generate(texts, ask, cache, description, most=most)
    text, rc = optimise_band(spark, path, made.queries, make, dims, steps, batch)
    return f"{text}; kept {made.kept} of {made.replies} replies", rc


def deep(m: M.Model, sources: DataFrame, make: Make, question: str, ask: Callable, max_hops: int = 4) -> Result:
    def retrieve(q: str) -> list[dict]:
        return [h.asDict() for h in _hits(m, sources, make, q, 5)[0] if h["text"]]

    return deep_search(question, retrieve, ask, max_hops, search.names_missing)
