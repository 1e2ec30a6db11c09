"""A memory store: rows and their band as Parquet parts, and numbered commits that name the parts that count.

A commit is one small file, created only if its number is free (on a POSIX or Hadoop file system; object stores need one
that renames without overwriting). So a change to both tables shows whole or not at all: what
a writer left behind when it died between the two has no commit and isn't read, and goes when old parts expire. Two
writers that reach for the same number find out: the loser reads what the other committed and replays its own
change on it. Appends write only their new rows; updates and deletions write the tables anew.

Layout: <path>/commits/<number>.json, <path>/parts/<writer>/{rows,band}.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrove.functions import text as T
from veritrove.functions.vectors import l2_normalize
from veritrove.sources.model import _fs, _get

# A row's fields, those that never change, and the tiers.
ROWS = "row_id string, text string, polarity array<string>, recurrence_count int, created_at string, last_corroborated_at string, transcript_hash string, is_bad boolean"
IMMUTABLE = ("row_id", "text", "created_at", "created_utc")
#: Entries of a layered memory.
ENTRIES = "row_id string, text string, salience double, created_utc string, recurrence_count int"
BAND = "row_id string, vec array<float>"
TIERS = ("working", "episodic", "semantic")
TRIES = 20

Change = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


class Conflict(RuntimeError):
    """Other writers were faster TRIES times in a row."""


class Store:
    """Rows and their vectors, of `dim` dimensions, at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, dim: int, schema: str = ROWS):
        self.spark, self.path, self.dim, self.schema = spark, path.rstrip("/"), dim, schema
        self.fields = [c.split()[0] for c in schema.split(", ")]

    # commits

    def versions(self) -> list[int]:
        p, fs = _fs(self.spark, f"{self.path}/commits")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _commit(self, number: int) -> dict:
        return json.loads(_get(self.spark, f"{self.path}/commits/{number:012d}.json")) if number else {"rows": [], "band": [], "n": 0, "watermark": None}

    def _try(self, number: int, commit: dict) -> bool:
        """Creates a commit's file, with all of its text in one step; False if another writer has that number."""
        tmp, fs = _fs(self.spark, f"{self.path}/commits/.{uuid.uuid4().hex}")
        to, _ = _fs(self.spark, f"{self.path}/commits/{number:012d}.json")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(commit, sort_keys=True).encode()))
        out.close()
        try:
            if fs.getScheme() == "file":  # where Hadoop looks first and renames then
                os.link(tmp.toUri().getPath(), to.toUri().getPath())
            else:
                jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(fs.makeQualified(tmp), fs.makeQualified(to), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            fs.delete(tmp, False)

    # reading

    def tables(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Rows and band of the newest version or the one given."""
        number = version if version is not None else max(self.versions(), default=0)
        return self._tables(self._commit(number))

    def _tables(self, commit: dict) -> tuple[DataFrame, DataFrame]:
        def read(kind: str, schema: str) -> DataFrame:
            parts = [self.spark.read.schema(schema).parquet(f"{self.path}/parts/{p}/{kind}") for p in commit[kind]]
            return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

        return read("rows", self.schema), read("band", BAND)

    def check(self, version: int | None = None) -> int:
        """The number of rows; refused if a row has no vector or two, a vector no row, or a vector another dimension."""
        rows, band = self.tables(version)
        n, ids = rows.agg(F.count("*"), F.count_distinct("row_id")).first()
        both = rows.select("row_id").join(band, "row_id").count()
        odd = band.agg(F.count("*"), F.count_if(F.col("vec").isNull() | (F.size("vec") != self.dim))).first()
        if n != ids or both != n or odd[0] != n or odd[1]:
            raise ValueError(f"{n} rows ({ids} ids), {odd[0]} vectors, {both} of both, {odd[1]} of another dimension than {self.dim}")
        return n

    # writing

    def _write(self, rows: DataFrame | None, band: DataFrame | None) -> str:
        part = uuid.uuid4().hex
        if rows is not None:
            rows.select(*self.fields).write.parquet(f"{self.path}/parts/{part}/rows")
        if band is not None:
            self._write_band(band, part)
        return part

    def _write_band(self, band: DataFrame, part: str) -> None:
        band.select("row_id", l2_normalize("vec").cast("array<float>").alias("vec")).write.parquet(f"{self.path}/parts/{part}/band")

    def add(self, rows: DataFrame, band: DataFrame) -> int:
        """Appends rows and their vectors; the new version. Refused: polarities without exactly one primary tag, rows and vectors that don't pair up."""
        part = self._write(rows.withColumn("polarity", T.valid_polarity(F.col("polarity"))) if "polarity" in self.fields else rows, band)
        new = self.spark.read.schema(self.schema).parquet(f"{self.path}/parts/{part}/rows").select("row_id")
        vectors = self.spark.read.schema(BAND).parquet(f"{self.path}/parts/{part}/band")
        n = new.count()
        if vectors.where(F.size("vec") == self.dim).join(new, "row_id").count() != n or vectors.count() != n:
            raise ValueError("each new row needs one vector of the store's dimension")
        return self._until_committed(lambda c: {"rows": [*c["rows"], part], "band": [*c["band"], part], "n": c["n"] + n})

    def _until_committed(self, change: Callable[[dict], dict]) -> int:
        for _ in range(TRIES):
            base = max(self.versions(), default=0)
            before = self._commit(base)
            if self._try(base + 1, {**before, **change(before), "base": base}):
                return base + 1
        raise Conflict(f"{self.path}: {TRIES} tries")

    def change(self, change: Change, band_too: bool = True) -> int:
        """Replaces both tables by what change(rows, band) makes of them; on a conflict it is made anew of the newer tables.

        With band_too False the band's parts stay as they are."""

        def replaced(c: dict) -> dict:
            rows, band = change(*self._tables(c))
            part = self._write(rows, band if band_too else None)
            out = {"rows": [part], "n": self.spark.read.schema(self.schema).parquet(f"{self.path}/parts/{part}/rows").count()}
            return out | ({"band": [part]} if band_too else {})

        return self._until_committed(replaced)

    def update(self, updates: DataFrame) -> int:
        """Sets the fields of rows that updates (row_id and any fields that may change) names; null leaves a field as it is."""
        fields = [c for c in updates.columns if c != "row_id"]
        free = set(self.fields) - set(IMMUTABLE)
        if not set(fields) <= free:
            raise ValueError(f"only {sorted(free)} may change")
        u = updates.select("row_id", *(F.col(c).alias(f"_{c}") for c in fields))
        if "polarity" in fields:
            u = u.withColumn("_polarity", F.when(F.col("_polarity").isNotNull(), T.valid_polarity(F.col("_polarity"))))

        def change(rows: DataFrame, band: DataFrame) -> tuple[DataFrame, DataFrame]:
            if not u.join(rows, "row_id", "left_anti").isEmpty():
                raise KeyError("no such row")
            return rows.join(u, "row_id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields}), band

        return self.change(change, band_too=False)

    def delete(self, doomed: DataFrame) -> int:
        """Deletes rows and vectors by row_id; the number of rows that went."""
        gone = doomed.select("row_id").distinct()
        before = max(self.versions(), default=0)
        after = self.change(lambda rows, band: (rows.join(gone, "row_id", "left_anti"), band.join(gone, "row_id", "left_anti")))
        return self._commit(after - 1 if after - 1 > before else before)["n"] - self._commit(after)["n"]

    # watermark, clean-up

    @property
    def watermark(self) -> str | None:
        """Up to when captures have been distilled."""
        return self._commit(max(self.versions(), default=0)).get("watermark")

    def advance(self, to: str) -> int:
        """Sets the watermark; it never goes back."""
        return self._until_committed(lambda c: {"watermark": max(to, c.get("watermark") or to)})

    def expire(self, keep: int = 2, hours: float = 24.0) -> int:
        """Removes commits but the last `keep`, and parts that those don't name and that are older than `hours`: what writers
        that died left, and what was replaced. The number of parts removed. A writer must not take longer than `hours`."""
        versions = self.versions()
        live = {p for v in versions[-keep:] for kind in ("rows", "band") for p in self._commit(v)[kind]}
        at, fs = _fs(self.spark, f"{self.path}/parts")
        old = [s for s in fs.listStatus(at) if s.getPath().getName() not in live and s.getModificationTime() / 1000 <= time.time() - hours * 3600] if fs.exists(at) else []
        for s in old:
            fs.delete(s.getPath(), True)
        for v in versions[:-keep]:
            fs.delete(_fs(self.spark, f"{self.path}/commits/{v:012d}.json")[0], False)
        return len(old)


class Tiers:
    """A layered memory: a store of entries for each tier. A tier is whole after any crash, as its two tables are committed as one."""

    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.stores = {t: Store(spark, f"{path.rstrip('/')}/{t}", dim, ENTRIES) for t in TIERS}

    def load(self, tier: str) -> tuple[DataFrame, DataFrame]:
        """A tier's entries and vectors, checked against one another."""
        self.stores[tier].check()
        return self.stores[tier].tables()

    def add(self, tier: str, entries: DataFrame, band: DataFrame) -> int:
        return self.stores[tier].add(entries, band)

    def replace(self, tier: str, entries: DataFrame, band: DataFrame) -> int:
        return self.stores[tier].change(lambda *_: (entries, band))

    def entries(self) -> DataFrame:
        """All tiers' entries, with their tier."""
        return reduce(DataFrame.unionByName, (s.tables()[0].withColumn("tier", F.lit(t)) for t, s in self.stores.items()))

    def retain(self, kept: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Deletes what kept(entries with `id` and `tier`) leaves out; how many entries each tier lost."""
        all_ = self.entries().withColumn("id", F.col("row_id"))
        good = kept(all_).select("id", "tier")
        gone = all_.join(good, ["id", "tier"], "left_anti").select("row_id", "tier")
        return {t: s.delete(gone.where(F.col("tier") == t)) for t, s in self.stores.items()}
