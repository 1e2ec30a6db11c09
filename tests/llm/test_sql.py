"""SQL twins on planted rows that the tables lack: cut notices, several licences in a file, repeated payloads."""

import duckdb
import numpy as np
import pyarrow as pa

from veritrove.llm import license_scan, warc
from veritrove.llm.oracles import ORACLES


def twin(name, **tables):
    con = duckdb.connect()
    for k, t in tables.items():
        con.register(k, t)
    found = con.sql(ORACLES[name])
    return found.columns, found.fetchall()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def planted_licenses():
    rng = np.random.default_rng(31)
    wordings = [t for _, _, t in license_scan.TEMPLATES]
    keys = [k for _, k, _ in license_scan.TEMPLATES] + list(license_scan.BASE_PHRASES)
    texts = [None, "", "\n\t", "GNU General\nPublic-License", "cc by", "cc_by cc by-nc", "mit licenses", "x" * 20_000 + " MIT License", "a " * 9_000 + "cc by nc 4.0"]
    texts += wordings + keys
    for t in wordings:
        w = t.split()
        texts.append(" ".join(w[len(w) // 3 :]))  # begins before the file
        texts.append(" ".join(w[: 2 * len(w) // 3]))  # ends after it
        texts.append(" ".join(x if rng.random() < 0.7 else "other" for x in w))
    for _ in range(60):  # several in a file, with prose of the same words between them
        parts = [wordings[k] if rng.random() < 0.6 else keys[k] for k in rng.integers(0, len(wordings), 4)]
        texts.append(". ".join(p + " " + " ".join(rng.choice(license_scan.VOCABULARY, 12)) for p in parts).title())
    return texts


def test_license_scan_against_sql(spark):
    texts = planted_licenses()
    t = pa.table({"doc_id": pa.array([*range(len(texts) - 1), 3], pa.int64()), "text": pa.array(texts, pa.string())})
    columns, rows = twin("op5_license_scan", documents=t)
    got = license_scan.license_scan(spark.createDataFrame(list(zip(t["doc_id"].to_pylist(), texts)), "doc_id long, text string"))
    assert ordered(got.select(*columns).collect()) == ordered(rows)
    assert len({r[columns.index("labels")] for r in rows}) > 30


def test_warc_against_sql(spark):
    html = [None, "", "same", "same", "é 漢字 🙂", "other", "same", "x" * 300_000, "é 漢字 🙂", None]
    ids = [9, 3, 7, 5, 1, 2, 6, 8, 4, 0]
    t = pa.table({"page_id": pa.array(ids, pa.int64()), "html": pa.array(html, pa.string())})
    columns, rows = twin("op8_warc", pages=t)
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in zip(ids, html)], "page_id long, url string, html string")
    assert ordered(warc.warc_round_trip(pages).select(*columns).collect()) == ordered(rows)
    empty = t.slice(0, 0)
    assert twin("op8_warc", pages=empty)[1] == []
