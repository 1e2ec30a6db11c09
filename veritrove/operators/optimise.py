"""Before a nested projection is trained (see training): queries, their filter, hard negatives, estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrove.operators import simjoin

STEPS = 250  # a fixed value: the steps of a training


def stratified(passages: DataFrame, per_file: int = 3, most: int = 6_000, seed: int = 0) -> DataFrame:
    """At most so many passages of each file and in all, in the order of a hash of seed and number."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col("passage_idx")), 256)
    w = Window.partitionBy("source_file").orderBy("_h")
    p = passages.withColumn("_h", h).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_file)
    return p.orderBy("_h").limit(most).drop("_h", "_r")


def good_query(q: str) -> bool:
    q = q.strip()
    return 10 <= len(q) <= 400 and "passage" not in q[:40].lower()


def good_queries(queries: DataFrame) -> DataFrame:
    """good_query() on a table with a column q."""
    q = F.trim("q")
    return queries.where(F.length(q).between(10, 400) & (F.instr(F.lower(F.substring(q, 1, 40)), "passage") == 0))


def anchors(lines: DataFrame, most: int = 5) -> DataFrame:
    """n, q of the first `most` lines (n, q) that have 3 to 30 words: examples for those who write queries."""
    return lines.where(F.size(F.filter(F.split("q", r"\s+"), lambda w: w != "")).between(3, 30)).orderBy("n").limit(most)


def first_choice_rate(queries: DataFrame, band: DataFrame, positives: DataFrame) -> DataFrame:
    """One row: rate, the share of queries whose nearest row is their positive (a, b)."""
    best = simjoin.nearest(queries, band, 1).select("a", "b")
    hit = positives.join(best.withColumn("hit", F.lit(1.0)), ["a", "b"], "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(0.0)).alias("rate"))


def retention(kept: int, emitted: int) -> float:
    """Kept queries by emitted ones; 0 without any."""
    return kept / emitted if emitted else 0.0


def hard_negatives(queries: DataFrame, band: DataFrame, positives: DataFrame, pool: int = 64, take: int = 7, seed: int = 0) -> DataFrame:
    """a (query), b, slot: of the nearest `pool` without the positive (a, b) the first `take` by hash; short pools repeat."""
    near = simjoin.nearest(queries, band, pool).join(positives.select("a", "b"), ["a", "b"], "left_anti")
    h = F.sha2(F.concat_ws(":", F.lit(seed), "a", "b"), 256)
    w = Window.partitionBy("a")
    picked = near.withColumn("r", F.row_number().over(w.orderBy(h)) - 1).withColumn("n", F.least(F.count("*").over(w), F.lit(take))).where(F.col("r") < take)
    slots = picked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(take - 1)))).where(F.col("slot") % F.col("n") == F.col("r"))
    return slots.select("a", "b", F.col("slot").cast("int").alias("slot"))


def estimate(n_queries: int, tokens_per_query: int = 900, price: float = 3.0) -> float:
    """Cost in dollars at a price per million tokens."""
    return n_queries * tokens_per_query * price / 1e6


def estimate_seconds(n_queries: int, seconds_per_call: float = 1.5, at_once: int = 8, steps: int = STEPS, seconds_per_step: float = 0.05) -> float:
    """Wall time of synthesis, so many calls at once, and of training."""
    return -(-n_queries // at_once) * seconds_per_call + steps * seconds_per_step
