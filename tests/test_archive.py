"""Models as archive files: round trips, files made by hand, ranges, refusals."""

import io
import json
import zipfile

import numpy as np
import pytest
import zstandard

from veritrove.sources import archive
from veritrove.sources import model as M


def by_hand(path, n=50, dim=6, ids=True, deflated=False, w=True, mode="bundled", **changes):
    """An archive as another writer makes it: plain zipfile and numpy."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lines = []
    for k in range(n):
        d = {"source_file": f"src/é{k % 7}.py", "char_offset": 10 * k, "char_length": 9, "content_hash": f"sha256:{k}"}
        lines.append(json.dumps(d | ({"id": f"{k:016x}"} if ids else {}), sort_keys=True))
    bands = {"base": {"role": "retrieval_default", "dim": dim, "l2_norm": True, "passage_count": n, "w_shape": None, "later": 1}}
    projection = rng.normal(size=(3, dim)).astype(np.float32)
    y = x @ projection.T
    if w:
        bands["optimised"] = {"role": "in_corpus_retrieval", "dim": 3, "w_shape": [3, dim], "trained_from": "base"}
    meta = {"format_version": 4, "backbone": {"name": "hand", "revision": "r1", "dim": dim}, "bands": bands, "store_mode": mode, "build_config": {"least": 1}, "new_key": [1, 2], **changes}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED if deflated else zipfile.ZIP_STORED) as z:
        z.writestr("metadata.json", json.dumps(meta))
        z.writestr("passages.jsonl", "\n".join(lines))
        for name, key, a in [("base", "embeddings", x)] + ([("optimised", "embeddings", y / np.linalg.norm(y, axis=1, keepdims=True)), ("optimised_W", "projection", projection)] if w else []):
            f = io.BytesIO()
            np.savez_compressed(f, **{key: a})
            z.writestr(f"bands/{name}.npz", f.getvalue())
        for k in range(7):
            z.writestr(f"source/src/é{k}.py", zstandard.ZstdCompressor().compress(f"text {k} 漢".encode()))
        if mode == "remote":
            z.writestr("manifest.json", json.dumps({"a b.md": {"url": "http://h/a%20b.md", "sha256": "1"}, "é": {"url": "u", "sha256": "2"}}))
    return x, projection


@pytest.mark.parametrize("deflated", [False, True])
def test_reading_by_ranges(spark, tmp_path, monkeypatch, deflated):
    monkeypatch.setattr(archive, "RANGE_BYTES", 333)
    monkeypatch.setattr(archive, "MATRIX_BYTES", 6 * 4 * 7)
    monkeypatch.setattr(archive, "RANGE_FILES", 2)
    path = str(tmp_path / "m.zip")
    x, w = by_hand(path, deflated=deflated)
    m = archive.read(spark, path)
    rows = m.passages.orderBy("passage_idx").collect()
    assert [(r.passage_idx, r.source_file, r.char_offset, r.content_hash, r.passage_id) for r in rows] == [(k, f"src/é{k % 7}.py", 10 * k, f"sha256:{k}", f"{k:016x}") for k in range(50)]
    got = m.base.orderBy("passage_idx").collect()
    assert [r.passage_idx for r in got] == list(range(50)) and np.allclose([r.vec for r in got], x)
    assert np.allclose(m.projections["optimised"], w) and m.band().count() == 50 and m.dim == 6 and m.revision == "r1"
    assert {r.source_file: r.text for r in m.sources.collect()} == {f"src/é{k}.py": f"text {k} 漢" for k in range(7)}
    if not deflated:
        assert len(archive._Reader({"path": path, "kind": "lines", "member": "passages.jsonl"}).partitions()) > 5
    assert len(archive._Reader({"path": path, "kind": "matrix", "member": "bands/base.npz", "key": "embeddings"}).partitions()) == 8


def test_lines_at_every_edge(spark, tmp_path, monkeypatch):
    """Numbers hold wherever the bytes are cut, also on and beside line ends."""
    path = str(tmp_path / "m.zip")
    by_hand(path, n=6, w=False)
    for size in (1, 2, 50, 51, 107, 108, 109, 5000):
        monkeypatch.setattr(archive, "RANGE_BYTES", size)
        reader = archive._Reader({"path": path, "kind": "lines", "member": "passages.jsonl"})
        found = [json.loads(j)["char_offset"] for p in reader.partitions() for b in reader.read(p) for j in b.column("json").to_pylist()]
        assert found == [0, 10, 20, 30, 40, 50]


def test_round_trip(spark, tmp_path):
    first, second = str(tmp_path / "a.zip"), str(tmp_path / "b.zip")
    x, w = by_hand(first)
    archive.write(archive.read(spark, first), second)
    with zipfile.ZipFile(first) as a, zipfile.ZipFile(second) as b:
        assert b.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in b.infolist())
        assert sorted(a.namelist()) == sorted(b.namelist())
        assert a.read("passages.jsonl") == b.read("passages.jsonl")
        for name, key in (("base", "embeddings"), ("optimised", "embeddings"), ("optimised_W", "projection")):
            y = np.load(b.open(f"bands/{name}.npz"))[key]
            assert y.dtype == np.float32 and np.allclose(y, np.load(a.open(f"bands/{name}.npz"))[key], atol=1e-6)
        meta = json.loads(b.read("metadata.json"))
        assert meta["new_key"] == [1, 2] and meta["bands"]["base"]["later"] == 1 and meta["bands"]["optimised"]["w_shape"] == [3, 6] and meta["backbone"]["name"] == "hand"
        assert all(zstandard.ZstdDecompressor().decompressobj().decompress(b.read(f"source/src/é{k}.py")).decode() == f"text {k} 漢" for k in range(7))
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".tmp")] == []
    # snapshot and archive hold the same model
    M.save(archive.read(spark, second), str(tmp_path / "snapshot"))
    again = M.load(spark, str(tmp_path / "snapshot"))
    assert np.allclose([r.vec for r in again.base.orderBy("passage_idx").collect()], x, atol=1e-6) and np.allclose(again.projections["optimised"], w)


def test_missing_ids_remote_and_empty(spark, tmp_path):
    path = str(tmp_path / "m.zip")
    by_hand(path, n=5, ids=False, mode="remote")
    m = archive.read(spark, path)
    import hashlib

    assert [r.passage_id for r in m.passages.orderBy("passage_idx").collect()] == [hashlib.sha256(f"src/é{k}.py\x1f{10 * k}\x1f9".encode()).hexdigest()[:16] for k in range(5)]
    want = [("a b.md", "http://h/a%20b.md", "1"), ("é", "u", "2")]
    assert sorted(map(tuple, m.manifest.collect())) == want and m.sources is None
    archive.write(m, str(tmp_path / "n.zip"))
    assert sorted(map(tuple, archive.read(spark, str(tmp_path / "n.zip")).manifest.collect())) == want
    empty = M.Model(m.passages.limit(0), {"base": m.base.limit(0)}, m.metadata)
    archive.write(empty, str(tmp_path / "e.zip"))
    got = archive.read(spark, str(tmp_path / "e.zip"))
    assert got.passages.count() == 0 and got.base.count() == 0


def test_refusals(spark, tmp_path):
    path = str(tmp_path / "m.zip")
    by_hand(path, n=4, format_version=5)
    with pytest.raises(ValueError, match="version"):
        archive.read(spark, path)
    for change in ("-bands/optimised_W.npz", "-bands/optimised.npz", "+bands/other.npz", "lines", "blank", "-manifest.json"):
        by_hand(path, n=4, mode="remote" if "manifest" in change else "local")
        with zipfile.ZipFile(path) as z:
            members = {n: z.read(n) for n in z.namelist() if n != change[1:]}
        if change.startswith("+"):
            members[change[1:]] = members["bands/base.npz"]
        elif change == "lines":
            members["passages.jsonl"] += b"\n" + members["passages.jsonl"].split(b"\n")[0]
        elif change == "blank":
            members["passages.jsonl"] = members["passages.jsonl"].replace(b"\n", b"\n\n", 1)
        with zipfile.ZipFile(path, "w") as z:
            for n, data in members.items():
                z.writestr(n, data)
        with pytest.raises(Exception, match="missing|declared|rows|source_file|manifest"):
            archive.read(spark, path).passages.collect()
    m = archive.read(spark, by_hand(path, n=4)[0] is None or path)
    with pytest.raises(ValueError):
        archive.write(M.Model(m.passages.where("passage_idx > 0"), {"base": m.base.where("passage_idx > 0")}), str(tmp_path / "x.zip"))
