"""Exact top-k search, verification against sources, confidence and rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from veritrove.functions import text as T
from veritrove.functions.vectors import dot
from veritrove.operators import simjoin

# The least top score and the largest share of drifted hits of each grounding mode.
MODES = {"augment": (0.30, 0.30), "knowledge": (0.15, 1.0), "constrain": (0.0, 1.0)}
CHARS_PER_TOKEN = 4
HEADERS = {
    "augment": "Grounding mode: augment. Prefer the passages below to what you know, and cite them.",
    "knowledge": "Grounding mode: knowledge. The passages below add to what you know.",
    "constrain": "Grounding mode: constrain. Answer only from the passages below, or refuse.",
}


def query_column(q: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in q))


def scored(band: DataFrame, q: list[float]) -> DataFrame:
    return band.withColumn("score", dot("vec", query_column(q)))


def top_k(band: DataFrame, q: list[float], k: int = 10, distinct_by: list[str] | None = None) -> DataFrame:
    """The k rows of band (id, vec, ...) nearest to q, without vec; ties go to the smaller id.

    With distinct_by, of rows alike in those columns only the best counts."""
    s = scored(band, q).drop("vec")
    if k <= 0:
        return s.limit(0)
    if distinct_by:
        best = F.max_by(F.struct("id", "score"), F.struct("score", (-F.col("id")).alias("n")))
        s = s.groupBy(*distinct_by).agg(best.alias("x")).select(*distinct_by, "x.id", "x.score")
    return s.orderBy(F.desc("score"), "id").limit(k)


def top_k_all(band: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, score, rank: the k rows of band nearest to each of queries (id, vec); ties go to the smaller id.

    Queries and band are multiplied block by block, so there may be any number of either."""
    if k <= 0:
        return queries.select(F.col("id").cast("long").alias("query_id"), F.col("id").cast("long"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    found = simjoin.nearest(queries, band, k)
    return found.select(F.col("a").alias("query_id"), F.col("b").alias("id"), F.col("cosine").alias("score"), F.col("rank").cast("long").alias("rank"))


def drift_status(found: Column, now: Column, then: Column) -> Column:
    return F.when(found.isNull(), "missing").when(now == then, "verified").otherwise("drifted")


def verified(passages: DataFrame, sources: DataFrame) -> DataFrame:
    """passages with text (the slice as it is now) and drift_status by re-hashing it."""
    s = sources.select("source_file", T.lf("text").alias("full"))
    j = passages.join(s, "source_file", "left").withColumn("text", F.expr("substring(full, char_offset + 1, char_length)"))
    return j.withColumn("drift_status", drift_status(F.col("full"), T.content_hash("text"), F.col("content_hash"))).drop("full")


def only_verified(hits: DataFrame) -> DataFrame:
    return hits.where("drift_status = 'verified'")


def confidence(hits: DataFrame) -> DataFrame:
    """One row: top1_score, top1_top2_gap (1 for a single hit), source_diversity, drift_fraction; zeros without hits."""
    top = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2)  # hits are a top-k, so few
    return hits.agg(
        F.count("*").alias("n"), top.alias("t"), F.count_distinct("source_file").alias("files"), F.avg((F.col("drift_status") != "verified").cast("double")).alias("drift")
    ).select(
        F.coalesce(F.get("t", F.lit(0)), F.lit(0.0)).alias("top1_score"),
        F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, 1.0).otherwise(F.get("t", F.lit(0)) - F.get("t", F.lit(1))).alias("top1_top2_gap"),
        F.when(F.col("n") == 0, 0.0).otherwise(F.col("files") / F.col("n")).alias("source_diversity"),
        F.coalesce("drift", F.lit(0.0)).alias("drift_fraction"),
    )


def suppressed(metrics: DataFrame, mode: str) -> DataFrame:
    least, most = MODES[mode]
    return metrics.withColumn("suppressed", (F.col("top1_score") < least) | (F.col("drift_fraction") > most))


def budget_cut(rows: DataFrame, length: Column, budget: int, order: list, partition: list[str] | None = None, first_always: bool = True) -> DataFrame:
    """The longest prefix whose lengths sum to no more than the budget; the first row always unless told otherwise."""
    w = Window.partitionBy(*(partition or [])).orderBy(*order)
    r = rows.withColumns({"_used": F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_rank": F.row_number().over(w)})
    keep = F.col("_used") <= budget
    return r.where(keep | (F.col("_rank") == 1) if first_always else keep).drop("_used", "_rank")


def context(hits: list[Row], metrics: Row, question: str, mode: str = "augment", tokens: int = 3000) -> tuple[str, list[str]]:
    """A bounded list of hits as Markdown, and the question's names that the shown passages lack."""
    least, most = MODES[mode]
    head = f"> {HEADERS[mode]}\n\n"
    if metrics["top1_score"] < least or metrics["drift_fraction"] > most:
        return head + f"*(no confident evidence in mode {mode}: top1 {metrics['top1_score']:.3f}, drift {metrics['drift_fraction']:.2f})*\n", []
    shown, used = [], 0
    for h in hits:
        if h["drift_status"] == "missing" or not h["text"]:
            continue
        block = f"<!-- {h['source_file']}:{h['char_offset']}+{h['char_length']} score={h['score']:.3f} {h['drift_status']} -->\n{h['text']}\n"
        if shown and used + len(block) > tokens * CHARS_PER_TOKEN:
            break
        shown.append((block, h["text"]))
        used += len(block)
    missing = names_missing(question, "\n".join(t for _, t in shown))
    refusal = refusal_directive(missing)
    return head + refusal + "\n".join(b for b, _ in shown), missing


def as_text(hits: list[Row]) -> str:
    return "\n".join(f"{h['score']:.3f} [{h['drift_status']}] {h['source_file']}:{h['char_offset']}+{h['char_length']}  {(h['text'] or '')[:200]}" for h in hits)


def as_json(hits: DataFrame) -> DataFrame:
    """One JSON string a hit, best first."""
    return hits.orderBy(F.desc("score"), "passage_idx").select(F.to_json(F.struct("source_file", "char_offset", "char_length", "score", "drift_status", "text")).alias("json"))


def refusal_directive(missing: list[str]) -> str:
    if not missing:
        return ""
    names = ", ".join(f"`{m}`" for m in missing)
    return f"> **Name check failed.** No passage holds {names}. Refuse, or ask whether the name is right; don't answer about a similar one.\n"


def names_missing(question: str, passages: str) -> list[str]:
    """text.missing_names for one pair of strings, without a job."""
    quoted = [q.strip(" ") for q in re.findall(r"['\"]([^'\"]+)['\"]", question)]
    words = re.findall(r"[A-Za-z][A-Za-z0-9\-]*", re.sub("[()]", " ", re.sub(r"['\"][^'\"]+['\"]", " ", question)))
    names = [q for q in quoted if len(q) >= 3] + [w for w in words if len(w) >= 2 and (w.upper() == w or re.search("[0-9]", w)) and w.lower() not in T.STOPWORDS]

    def held(t: str) -> bool:
        if t.upper() == t and t.lower() != t and len(t) <= 6:
            return re.search(rf"\b{re.escape(t)}\b", passages) is not None
        return t.lower() in passages.lower()

    return [t for t in dict.fromkeys(names) if not held(t)]


def table_of_contents(passages: DataFrame, budget: int = 800 * CHARS_PER_TOKEN) -> str:
    """Files by number of passages, ties by first passage, until the budget is spent; then how many more."""
    files = passages.groupBy("source_file").agg(F.count("*").alias("n"), F.min("passage_idx").alias("first"))
    total = files.count()
    out, used = [], 0
    for r in files.orderBy(F.desc("n"), "first").limit(budget // 8 + 1).collect():  # each line has eight characters at least
        line = f"- {r['source_file']} ({r['n']})"
        if used + len(line) + 1 > budget and out:
            break
        out.append(line)
        used += len(line) + 1
    if len(out) < total:
        out.append(f"- …and {total - len(out)} more")
    return "\n".join(out)
