"""Commands end to end over small folders and fake openers."""

import functools

import numpy as np
import pytest

from veritrove.functions.encode import hashed_encoder
from veritrove.operators import ann, corpus, search
from veritrove.plans import commands as C
from veritrove.sources import model as M


make = functools.partial(hashed_encoder, 32)


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("Alpha beta engines run. " * 20)
    (tmp_path / "docs" / "b.md").write_text("Gamma delta pumps stop. " * 20)
    return tmp_path


def test_build_search_refresh(spark, folder):
    path = str(folder / "model")
    text, rc = C.build(spark, [str(folder / "docs")], path, make)
    assert rc == 0 and text.startswith("2 passages")
    m = M.load(spark, path)
    text, rc = C.find(m, m.sources, make, "Alpha beta engines", 1)
    assert rc == 0 and "a.md" in text
    assert C.find(m, m.sources, make, "Alpha XYZ9 engines", 2, mode="constrain", strict_names=True)[1] == 3
    text = C.profile(m, m.sources)[0]
    assert "verified: 2" in text and "bands: base (" in text and "skipped" in C.profile(m)[0]
    p = corpus.profile_of(m, m.sources)
    assert (p.passages, p.source_files, p.drift, p.format_version) == (2, 2, {"verified": 2}, 4) and p.bands == {"base": m.dim}
    other = M.Model(m.passages, m.bands, m.metadata | {"revision": "other"})
    assert corpus.between(corpus.intersect, m, m, 0.9).count() >= 2 and corpus.between(corpus.unique, m, other, same_revision=False).count() == 0
    with pytest.raises(ValueError):
        corpus.between(corpus.intersect, m, other)
    with pytest.raises(ValueError):
        corpus.between(corpus.unique, m, M.Model(m.passages, m.bands, m.metadata | {"dim": 3}), same_revision=False)
    assert "overlap: 1.0000" in C.compare(m, m)[0]
    text, _ = C.summary(m, m.sources, make, ["pumps"])
    assert "## Landscape" in text and "- b.md (1)" in text and "### pumps" in text
    text, rc = C.skill_context(m, m.sources, make, ["Alpha beta engines", "pumps"])
    assert rc == 0 and text.count("### ") == 2
    assert C.refresh(spark, path, [str(folder / "docs")], make)[0] == "unchanged: 2, updated: 0, added: 0, removed: 0"
    (folder / "docs" / "b.md").write_text("Gamma delta pumps STOP. " * 20)
    edited, _ = C.files.walk(spark, [str(folder / "docs")], str(folder / "docs"))
    assert C.skill_context(m, edited, make, ["pumps"], strict=True)[1] == 2
    assert C.convert(spark, path, str(folder / "x"), edited, "local")[1] == 2
    assert C.refresh(spark, path, [str(folder / "docs")], make)[0] == "unchanged: 1, updated: 1, added: 0, removed: 0"
    replies = iter(["pumps", '{"action": "answer", "answer": "they stop"}'])
    assert C.deep(M.load(spark, path), edited, make, "what do pumps do?", lambda *a: (next(replies), 1, 1)).answer == "they stop"


def test_remote(spark, folder, tmp_path):
    path, remote = str(folder / "model"), str(folder / "remote")
    C.build(spark, [str(folder / "docs")], path, make)
    m = M.load(spark, path)
    assert C.freshness(m, lambda url: b"")[1] == 1
    assert C.convert(spark, path, remote, m.sources, "remote", "https://h/x")[1] == 0
    live = {f"https://h/x/{r.source_file}": r.text.encode() for r in m.sources.collect()}

    def opener(url, live=live):
        if url not in live:
            raise OSError(url)
        return live[url]

    r = M.load(spark, remote)
    assert r.sources is None and C.freshness(r, opener) == ("verified: 2", 0)
    live["https://h/x/a.md"] = live["https://h/x/a.md"].replace(b"Alpha", b"ALPHA")
    del live["https://h/x/b.md"]

    def later(url, live=dict(live)):
        if url not in live:
            raise OSError(url)
        return live[url]

    assert C.freshness(r, later)[1] == 2
    assert C.sync(spark, remote, later, make)[1] == 2
    text, rc = C.sync(spark, remote, later, make, allow_unavailable=True)
    assert rc == 0 and text == "unchanged: 1, updated: 1, added: 0, removed: 0"
    assert M.load(spark, remote).manifest.count() == 2


def test_optimise(spark, folder):
    path = str(folder / "model")
    C.build(spark, [str(folder / "docs")], path, make)
    queries = spark.createDataFrame([(k % 2, ("Alpha beta engines", "Gamma delta pumps")[k % 2] + f" {k}") for k in range(40)], "passage_idx long, query string")
    text, rc = C.optimise_band(spark, path, queries, make, (8, 16), steps=3, batch=8)
    m = M.load(spark, path)
    assert rc == 0 and m.band().count() == 2 and len(m.band().first().vec) == 16 and text.startswith("optimised: 16 dimensions")
    base = {r.passage_idx: np.array(r.vec) for r in m.base.collect()}
    for r in m.band().collect():
        y = m.projections["optimised"] @ base[r.passage_idx]
        assert np.allclose(y / np.linalg.norm(y), r.vec, atol=1e-5)
    assert C.optimise_band(spark, path, queries.limit(3), make, (8, 16))[1] == 1


def test_inverted_file_recall(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(12, 16))
    x = centers[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    band = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    cells = ann.fit_cells(band, 12)
    index = ann.indexed(band, cells).cache()
    hits = 0
    for k in range(0, 600, 60):
        q = [float(v) for v in x[k]]
        hits += len({r.id for r in ann.search(index, cells, q, 10, 4).collect()} & {r.id for r in search.top_k(band, q, 10).collect()})
    assert hits >= 90
