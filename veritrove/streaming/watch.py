"""Structured Streaming: a listing source that sees edits and removals, refresh on change, and capture of new transcripts."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql import functions as F

BLOCKED = frozenset((".git", "node_modules", "__pycache__", ".venv", "dist", "build"))


class ListingReader(SimpleDataSourceStreamReader):
    """Its offset is the folder's listing; a batch is the difference of two. For large trees give each a digest a folder."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def listing(self) -> dict[str, list]:
        out = {}
        for folder, names, files in os.walk(self.path):
            names[:] = [n for n in names if n not in BLOCKED]
            for f in files:
                full = os.path.join(folder, f)
                try:
                    s = os.stat(full)
                except FileNotFoundError:
                    continue
                out[os.path.relpath(full, self.path)] = [s.st_mtime_ns, s.st_size]
        return out

    def _rows(self, old: dict, new: dict) -> Iterator[tuple]:
        rows = [(k, "added" if k not in old else "changed") for k, v in new.items() if old.get(k) != v]
        return iter(sorted(rows + [(k, "removed") for k in old if k not in new]))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self.listing()
        return self._rows(json.loads(start["files"]), now), {"files": json.dumps(now, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(json.loads(start["files"]), json.loads(end["files"]))


class Listing(DataSource):
    """spark.readStream.format("veritrove_listing").option("path", folder): source_file, change."""

    @classmethod
    def name(cls) -> str:
        return "veritrove_listing"

    def schema(self) -> str:
        return "source_file string, change string"

    def simpleStreamReader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"])


def on_change(spark: SparkSession, folder: str, checkpoint: str, reconcile: Callable[[DataFrame, int], None], once: bool = False, debounce: str = "1 second"):
    """Starts a query that calls reconcile(changes, batch) after each change; with once it stops when it has caught up."""
    spark.dataSource.register(Listing)
    changes = spark.readStream.format("veritrove_listing").option("path", folder).load()
    trigger = {"availableNow": True} if once else {"processingTime": debounce}
    return changes.writeStream.foreachBatch(lambda df, k: None if df.isEmpty() else reconcile(df, k)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def capture_stream(messages: DataFrame, capture: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True):
    """Appends what capture() makes of each batch of whole transcripts to a Parquet table, by batch number, so a repeat overwrites itself."""

    def write(df: DataFrame, k: int) -> None:
        capture(df).write.mode("overwrite").parquet(f"{target}/batch={k}")

    trigger = {"availableNow": True} if once else {"processingTime": "10 seconds"}
    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def transcript_hashes(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("transcript_hash")).distinct()
