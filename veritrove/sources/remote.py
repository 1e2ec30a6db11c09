"""Remote sources: texts in a cache keyed by their hash, and feeds that say what has changed upstream."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrove.operators.incremental import manifest_diff
from veritrove.plans.session import written
from veritrove.sources.files import fetched
from veritrove.sources.model import _fs

CACHED = "sha256 string, text string"


class TextCache:
    """Texts by their sha256, as a table that only grows. A text is written under the hash it really has, so a reader can trust
    the key; a source that is pinned anew misses the cache, and sources with the same text share one row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        p, fs = _fs(self.spark, self.path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], CACHED)
        return self.spark.read.schema(CACHED).parquet(self.path)

    def texts(self, manifest: DataFrame, opener: Callable[[str], bytes], strict: bool = True) -> DataFrame:
        """source_file, url, pinned, sha256, text, ok for manifest (source_file, url, sha256): from the cache, the rest by opener.

        strict: a text that isn't what the manifest pins is an error (null where it can't be fetched is not)."""
        m = manifest.select("source_file", "url", "sha256")
        known = self.table()
        # a hash may be pinned by many sources: each is fetched once
        missing = written(m.join(known.select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"]), "missing")
        got = written(fetched(missing, opener), "fetched")
        if strict:
            wrong = got.where("text is not null and not ok").select("source_file", "pinned", "sha256").first()
            if wrong is not None:
                raise ValueError(f"{wrong.source_file}: its hash is {wrong.sha256}, not {wrong.pinned}")
        new = got.where("text is not null").select("sha256", "text").dropDuplicates(["sha256"]).join(known.select("sha256"), "sha256", "left_anti")
        if not new.isEmpty():
            new.write.mode("append").parquet(self.path)
        # what came for a hash, also where it isn't that text
        found = known.dropDuplicates(["sha256"]).select(F.col("sha256").alias("pinned"), "text", "sha256").union(got.where("text is not null").select("pinned", "text", "sha256")).dropDuplicates(["pinned"])
        out = m.withColumnRenamed("sha256", "pinned").join(found, "pinned", "left")
        return out.select("source_file", "url", "pinned", "sha256", "text", (F.col("sha256") == F.col("pinned")).alias("ok"))


class Feed(Protocol):
    """What upstream has: a name of its present state, and the sources in it."""

    def head(self) -> str: ...

    def catalogue(self) -> DataFrame:
        """source_file, url, sha256."""
        ...


class ManifestFeed:
    """A feed over a JSON document {source_file: {url, sha256}} at a url. It is the authority on which sources there are."""

    def __init__(self, spark: SparkSession, url: str, opener: Callable[[str], bytes]):
        self.spark, self._text = spark, opener(url).decode()

    def head(self) -> str:
        return hashlib.sha256(self._text.encode()).hexdigest()

    def catalogue(self) -> DataFrame:
        rows = self.spark.createDataFrame([(self._text,)], "t string").select(F.explode(F.from_json("t", "map<string, struct<url: string, sha256: string>>", {"mode": "FAILFAST"})).alias("source_file", "x"))
        return rows.select("source_file", "x.url", "x.sha256")


def changed_since(pinned: DataFrame, feed: Feed, head: str | None = None) -> DataFrame:
    """source_file, bucket (added, modified, removed) against what is pinned; nothing if head is the feed's own."""
    d = manifest_diff(pinned, feed.catalogue()).where("bucket <> 'unchanged'")
    return d.limit(0) if head is not None and head == feed.head() else d
