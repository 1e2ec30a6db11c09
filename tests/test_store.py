"""The memory store: appends, updates, deletions, writers at once, a writer that dies between the tables, clean-up."""

import threading

import pytest
from pyspark.sql import functions as F

from veritrove.sources import store as S


def rows_of(spark, ids, **changes):
    row = {"text": "t", "polarity": ["prefer", "workspace:x"], "recurrence_count": 1, "created_at": "2024-01-01T00:00:00Z", "last_corroborated_at": "2024-01-01T00:00:00Z", "transcript_hash": "manual", "is_bad": False} | changes
    rows = spark.createDataFrame([(i, *row.values()) for i in ids], S.ROWS)
    return rows, spark.createDataFrame([(i, [3.0, 0.0, 4.0]) for i in ids], S.BAND)


def ids(store, version=None):
    return sorted(r.row_id for r in store.tables(version)[0].collect())


def test_versions(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "m"), 3)
    assert ids(s) == [] and s.check() == 0 and s.watermark is None
    assert s.add(*rows_of(spark, "abc")) == 1 and s.add(*rows_of(spark, "de")) == 2
    assert ids(s) == list("abcde") and ids(s, 1) == list("abc") and s.check() == 5
    assert [round(v, 6) for v in s.tables()[1].first().vec] == [0.6, 0.0, 0.8]
    s.update(spark.createDataFrame([("a", 7, True), ("b", None, True)], "row_id string, recurrence_count int, is_bad boolean"))
    got = {r.row_id: (r.recurrence_count, r.is_bad) for r in s.tables()[0].collect()}
    assert got["a"] == (7, True) and got["b"] == (1, True) and got["c"] == (1, False)
    assert s.delete(spark.createDataFrame([("a",), ("zz",)], "row_id string")) == 1
    assert ids(s) == list("bcde") and s.check() == 4
    s.advance("2024-02-01")
    s.advance("2024-01-01")
    assert s.watermark == "2024-02-01" and ids(s) == list("bcde")


def test_refusals(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "m"), 3)
    s.add(*rows_of(spark, "ab"))
    rows, band = rows_of(spark, "cd")
    for bad in (band.limit(1), band.union(band), band.withColumn("vec", F.array(F.lit(1.0)).cast("array<float>")), rows_of(spark, "xy")[1]):
        with pytest.raises(ValueError):
            s.add(rows, bad)
    with pytest.raises(Exception):
        s.add(*rows_of(spark, "e", polarity=["prefer", "avoid"]))
    for change in ("text string", "row_id2 string", "created_at string"):
        with pytest.raises(ValueError):
            s.update(spark.createDataFrame([("a", "x")], f"row_id string, {change}"))
    with pytest.raises(KeyError):
        s.update(spark.createDataFrame([("nobody", True)], "row_id string, is_bad boolean"))
    with pytest.raises(Exception):
        s.update(spark.createDataFrame([("a", ["none"])], "row_id string, polarity array<string>"))
    assert ids(s) == ["a", "b"] and s.check() == 2


def test_a_writer_dies_between_the_tables(spark, tmp_path, monkeypatch):
    s = S.Store(spark, str(tmp_path / "m"), 3)
    s.add(*rows_of(spark, "ab"))

    def dies(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(S.Store, "_write_band", dies)  # the rows are written, the band isn't
        with pytest.raises(OSError):
            s.add(*rows_of(spark, "c"))
    with monkeypatch.context() as m:
        m.setattr(S.Store, "_try", dies)  # both are written, the commit isn't
        with pytest.raises(OSError):
            s.add(*rows_of(spark, "d"))
    assert ids(s) == ["a", "b"] and s.check() == 2
    s.add(*rows_of(spark, "e"))
    assert ids(s) == ["a", "b", "e"] and s.check() == 3
    assert s.expire(keep=1, hours=24) == 0  # young parts may belong to a writer at work
    assert s.expire(keep=1, hours=0) == 2
    assert ids(s) == ["a", "b", "e"] and s.check() == 3 and s.versions() == [2]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "m"), 3)
    s.add(*rows_of(spark, ["r0"]))
    failed = []

    def work(k):
        try:
            mine = S.Store(spark, str(tmp_path / "m"), 3)
            for i in range(3):
                mine.add(*rows_of(spark, [f"w{k}-{i}"]))
            mine.change(lambda rows, band: (rows.withColumn("recurrence_count", F.when(F.col("row_id") == "r0", F.col("recurrence_count") + 1).otherwise(F.col("recurrence_count"))), band), band_too=False)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert ids(s) == sorted(["r0", *(f"w{k}-{i}" for k in range(3) for i in range(3))]) and s.check() == 10
    assert s.tables()[0].where("row_id = 'r0'").first().recurrence_count == 4 and s.versions() == list(range(1, 14))


def test_a_conflict_is_replayed_or_given_up(spark, tmp_path, monkeypatch):
    s, other = (S.Store(spark, str(tmp_path / "m"), 3) for _ in range(2))
    s.add(*rows_of(spark, "ab"))
    seen = []

    def change(rows, band):
        seen.append(rows.count())
        if len(seen) == 1:
            other.add(*rows_of(spark, "c"))  # in between
        return rows.where("row_id <> 'a'"), band.where("row_id <> 'a'")

    s.change(change)
    assert seen == [2, 3] and ids(s) == ["b", "c"] and s.check() == 2
    monkeypatch.setattr(S.Store, "_try", lambda *a: False)
    with pytest.raises(S.Conflict):
        s.advance("x")


def test_tiers(spark, tmp_path):
    from veritrove.operators import memory

    t = S.Tiers(spark, str(tmp_path / "layers"), 3)
    entries = lambda ids, stamp: spark.createDataFrame([(i, "t", 1.0, stamp, 1) for i in ids], S.ENTRIES)
    t.add("working", entries("ab", "2024-01-01T00:00:00Z"), rows_of(spark, "ab")[1])
    t.add("working", entries("c", "2023-01-01T00:00:00Z"), rows_of(spark, "c")[1])
    t.add("semantic", entries("d", "2020-01-01T00:00:00Z"), rows_of(spark, "d")[1])
    assert sorted((r.row_id, r.tier) for r in t.entries().collect()) == [("a", "working"), ("b", "working"), ("c", "working"), ("d", "semantic")]
    lost = t.retain(lambda e: memory.retained(e, F.lit("2024-01-01T06:00:00Z").cast("timestamp")))
    assert lost == {"working": 1, "episodic": 0, "semantic": 0}
    assert sorted(r.row_id for r in t.load("working")[0].collect()) == ["a", "b"] and t.load("episodic")[0].count() == 0
    t.replace("working", entries("z", "2024-01-01T00:00:00Z"), rows_of(spark, "z")[1])
    assert [r.row_id for r in t.load("working")[1].collect()] == ["z"]
    s = t.stores["working"]
    part = s._commit(max(s.versions()))["band"][0]
    spark.createDataFrame([("zz", [1.0, 0.0, 0.0])], S.BAND).write.mode("append").parquet(f"{s.path}/parts/{part}/band")
    with pytest.raises(ValueError):
        t.load("working")
