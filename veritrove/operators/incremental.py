"""Deltas between a model and its sources, by full outer joins on stable keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrove.functions import text as T
from veritrove.operators.corpus import numbered

KEYS = ["source_file", "char_offset", "char_length"]


def bucketise(old: DataFrame, new: DataFrame) -> DataFrame:
    """passage_id, bucket (unchanged, updated, added, removed), with both sides' hashes.

    Of repeated old ids the last passage_idx counts; of repeated new ones any."""
    o = old.groupBy("passage_id").agg(F.max_by("content_hash", "passage_idx").alias("old_hash"), F.max("passage_idx").alias("old_idx"))
    n = new.dropDuplicates(["passage_id"]).withColumnRenamed("content_hash", "new_hash")
    bucket = F.when(F.col("old_idx").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("updated")
    return o.join(n, "passage_id", "full_outer").withColumn("bucket", bucket)


def protect_skipped(delta: DataFrame, old: DataFrame, skipped: DataFrame) -> DataFrame:
    """Passages of files that couldn't be read aren't removed: they stay unchanged."""
    unread = old.join(skipped.select("source_file").distinct(), "source_file", "left_semi").select("passage_id").distinct().withColumn("_unread", F.lit(True))
    d = delta.join(unread, "passage_id", "left")
    return d.withColumn("bucket", F.when((F.col("bucket") == "removed") & F.col("_unread"), "unchanged").otherwise(F.col("bucket"))).drop("_unread")


def apply_delta(old: DataFrame, old_band: DataFrame, delta: DataFrame, encode) -> tuple[DataFrame, DataFrame]:
    """The new passages and base band: unchanged rows keep their vectors, updated and added ones are encoded.

    Numbers run over unchanged, then updated, then added rows, by file and offset. delta needs text for what is encoded."""
    rank = F.when(F.col("bucket") == "unchanged", 0).when(F.col("bucket") == "updated", 1).otherwise(2)
    keep = delta.where("bucket <> 'removed'")
    cols = ["passage_id", "source_file", "char_offset", "char_length", "content_hash"]
    same = keep.where("bucket = 'unchanged'").select(F.col("old_idx").alias("passage_idx")).join(old, "passage_idx").join(old_band, "passage_idx")
    same = same.select(*cols, F.lit(0).alias("_rank"), F.col("vec").cast("array<float>"))
    fresh = keep.where("bucket <> 'unchanged'").select("passage_id", "source_file", "char_offset", "char_length", F.col("new_hash").alias("content_hash"), rank.alias("_rank"), encode(F.col("text")).alias("vec"))
    rows = numbered(same.union(fresh), ["_rank", "source_file", "char_offset"])
    return rows.select("passage_idx", *cols), rows.select("passage_idx", "vec")


def manifest(sources: DataFrame, prefix: str) -> DataFrame:
    """source_file, url, sha256."""
    return sources.select("source_file", F.concat(F.lit(prefix.rstrip("/") + "/"), T.url_quoted(F.col("source_file"))).alias("url"), F.sha2("text", 256).alias("sha256"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """source_file, bucket (added, removed, modified, unchanged): modified on another url or hash."""
    o = old.select("source_file", F.col("url").alias("o_url"), F.col("sha256").alias("o_sha"))
    n = new.select("source_file", F.col("url").alias("n_url"), F.col("sha256").alias("n_sha"))
    same = F.col("o_url").eqNullSafe(F.col("n_url")) & F.col("o_sha").eqNullSafe(F.col("n_sha"))
    bucket = F.when(F.col("o_url").isNull(), "added").when(F.col("n_url").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return o.join(n, "source_file", "full_outer").select("source_file", bucket.alias("bucket"))


def manifest_poll(pinned: DataFrame, fetched: DataFrame) -> DataFrame:
    """source_file, bucket: modified by hash, unavailable where nothing could be fetched (never removed)."""
    f = fetched.select("source_file", F.col("sha256").alias("now"))
    bucket = F.when(F.col("now").isNull(), "unavailable").when(F.col("now") == F.col("sha256"), "unchanged").otherwise("modified")
    return pinned.join(f, "source_file", "left").select("source_file", bucket.alias("bucket"))


def freshness(pinned: DataFrame, fetched: DataFrame) -> DataFrame:
    """source_file, status (verified, drifted, missing)."""
    p = manifest_poll(pinned, fetched)
    status: Column = F.when(F.col("bucket") == "unchanged", "verified").when(F.col("bucket") == "unavailable", "missing").otherwise("drifted")
    return p.select("source_file", status.alias("status"))
