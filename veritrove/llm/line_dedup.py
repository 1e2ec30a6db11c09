"""Line dedup by distinct-site spread.

Each line's hash carries a HyperLogLog sketch of the sites (sources) it occurs
on; sketches merge by aggregation. Lines whose estimate is near the threshold
get an exact distinct count. Lines on at least `min_sites` sites are
boilerplate: all but the occurrences in the smallest doc_id go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.plans.session import written

MIN_SITES = 8
#: 2**LG_K registers; the standard error is about 1.04 / 2**(LG_K / 2), 6.5 %.
LG_K = 8
#: Estimates within this share of the threshold are counted exactly: over four standard errors.
NEAR = 0.3


def _lines() -> F.Column:
    return F.split(F.coalesce("text", F.lit("")), "\n")


def line_sites(docs: DataFrame) -> DataFrame:
    """doc_id, site, line (hash) of each document's distinct non-blank lines. Null sources are the site ''."""
    lines = F.array_distinct(F.filter(_lines(), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    site = F.xxhash64(F.coalesce("source", F.lit("")))
    # outer: else the optimiser tests the array's size first, and takes the lines twice
    exploded = docs.select("doc_id", site.alias("site"), F.explode_outer(F.transform(lines, lambda x: F.xxhash64(x))).alias("line"))
    return exploded.where("line is not null")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line, keeper (its smallest doc_id) of the lines on at least min_sites sites."""
    # sites and documents of a line are first joined to one row per site, so a line that is everywhere stays small
    by_line = lines.groupBy("line").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("doc_id").alias("keeper"), F.min("site").alias("lo"), F.max("site").alias("hi")
    )
    spread = by_line.where("lo <> hi").select("line", "keeper", F.hll_sketch_estimate("sketch").alias("estimate"))
    spread = written(spread.where(F.col("estimate") >= min_sites * (1 - NEAR)), "spread")
    sure = spread.where(F.col("estimate") > min_sites * (1 + NEAR)).select("line", "keeper")
    near = spread.where(F.col("estimate") <= min_sites * (1 + NEAR)).select("line", "keeper")
    exact = lines.join(near.select("line"), "line", "left_semi").select("line", "site").distinct().groupBy("line").agg(F.count("*").alias("sites"))
    return sure.union(near.join(exact.where(F.col("sites") >= min_sites), "line").select("line", "keeper"))


def _marked(docs: DataFrame, min_sites: int) -> DataFrame:
    """_doc (the row), doc_id, text and `_drop`, the hashes of the lines that leave each row (null for none)."""
    lines = line_sites(docs.select("doc_id", "text", "source"))
    flagged = written(boilerplate(lines, min_sites), "boilerplate")
    hits = lines.join(flagged, "line").where("keeper is null or doc_id > keeper").groupBy("doc_id").agg(F.collect_set("line").alias("_drop"))
    return docs.select(F.struct("*").alias("_doc"), "doc_id", "text").join(hits, "doc_id", "left")


def _kept() -> F.Column:
    return F.filter(_lines(), lambda x: ~F.coalesce(F.array_contains("_drop", F.xxhash64(x)), F.lit(False)))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed (long), text (what stays) for every row of docs (doc_id, text, source).

    Lines split at \\n and compare byte for byte by 64-bit hash; blank lines
    always stay. Null text counts as empty. All rows with the smallest doc_id keep the
    line, so a row with a null doc_id keeps all of its lines. Extra columns are
    ignored."""
    d = _marked(docs.select("doc_id", "text", "source"), min_sites)
    kept = F.when(F.col("_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(_kept(), "\n"))
    n = F.size(_lines())
    left = F.when(F.col("_drop").isNull(), n).otherwise(F.size(_kept()))
    return d.select("doc_id", n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_removed"), kept.alias("text"))


def strip_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines out of text and n_chars set anew; rows that lose all their words go.

    Other rows stay as they are, also those of null, empty or blank text and those with a null doc_id; repeated
    rows are treated alike; lines and texts may be of any length; other columns may have any names; an empty table stays empty."""
    d = _marked(docs, min_sites)
    changed = F.col("_drop").isNotNull()
    d = d.withColumn("text", F.when(changed, F.array_join(_kept(), "\n")).otherwise(F.col("text")))
    row = F.col("_doc").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("_doc.n_chars")))
    return d.where(~changed | (F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "")).select(row.alias("_doc")).select("_doc.*")
