"""Remote texts by hash, feeds, and a sync that fetches only what changed."""

import hashlib
import json

import pytest

from veritrove.functions.encode import hashed_encoder
from veritrove.plans import commands as C
from veritrove.sources import model as M
from veritrove.sources.remote import ManifestFeed, TextCache, changed_since

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def manifest(spark, texts):
    return spark.createDataFrame([(k, f"u/{k}", sha(t)) for k, t in texts.items()], "source_file string, url string, sha256 string")


def web_of(log, texts):
    """An opener over texts. It runs on the workers, so its calls are counted in a file."""
    log = str(log)

    def open_url(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        if url not in texts:
            raise OSError(url)
        return texts[url].encode()

    return open_url


def calls(log):
    return sorted(open(log).read().split())


def test_cache(spark, tmp_path):
    texts = {"a": "alpha\r\nline", "b": "beta", "c": "beta", "d": "delta"}
    clean = {k: t.replace("\r\n", "\n") for k, t in texts.items()}
    upstream, log = {f"u/{k}": t for k, t in texts.items()}, tmp_path / "log"
    web = web_of(log, upstream)
    cache = TextCache(spark, str(tmp_path / "cache"))
    got = {r.source_file: (r.text, r.ok) for r in cache.texts(manifest(spark, clean), web).collect()}
    assert got == {k: (t, True) for k, t in clean.items()} and len(calls(log)) == 3  # b and c are the same text
    got = {r.source_file: r.text for r in cache.texts(manifest(spark, clean), web).collect()}
    assert got == clean and len(calls(log)) == 3 and cache.table().count() == 3
    upstream["u/d"] = "other"
    assert len(cache.texts(manifest(spark, clean), web).collect()) == 4 and len(calls(log)) == 3  # what is pinned is there
    with pytest.raises(ValueError, match="d: its hash"):
        cache.texts(manifest(spark, clean | {"d": "new"}), web)
    loose = {r.source_file: (r.text, r.ok) for r in cache.texts(manifest(spark, clean | {"d": "new", "e": "gone"}), web, strict=False).collect()}
    assert loose["d"] == ("other", False) and loose["e"] == (None, None) and loose["a"] == (clean["a"], True)
    assert all(r.sha256 == sha(r.text) for r in cache.table().collect())


def test_sync_by_feed(spark, tmp_path):
    make = lambda: hashed_encoder(16)
    texts = {"a.md": "Alpha beta. " * 40, "b.md": "Gamma delta. " * 40}
    sources = spark.createDataFrame(list(texts.items()), "source_file string, text string")
    m = M.build(sources, make, bundle=False)
    m.manifest = manifest(spark, texts)
    path = str(tmp_path / "m")
    M.save(m, path)
    now = texts | {"b.md": "Gamma delta. " * 40 + "More.", "c.md": "New text. " * 40}
    upstream, log = {f"u/{k}": t for k, t in now.items()} | {"index": json.dumps({k: {"url": f"u/{k}", "sha256": sha(t)} for k, t in now.items()})}, tmp_path / "log"
    web = web_of(log, upstream)
    feed = ManifestFeed(spark, "index", web)
    assert {r.source_file: r.bucket for r in changed_since(m.manifest, feed).collect()} == {"b.md": "modified", "c.md": "added"}
    assert changed_since(m.manifest, feed, feed.head()).count() == 0
    cache = str(tmp_path / "cache")
    text, rc = C.sync(spark, path, web, make, feed=feed, cache=cache)
    assert rc == 0 and "unchanged: 1" in text and calls(log) == ["index", "u/a.md", "u/b.md", "u/c.md"]
    assert C.sync(spark, path, web, make, feed=feed, cache=cache) == ("unchanged upstream", 0)
    upstream["index"] = json.dumps({k: {"url": f"u/{k}", "sha256": sha(t)} for k, t in texts.items()})
    upstream["u/b.md"] = texts["b.md"]
    text, rc = C.sync(spark, path, web, make, feed=ManifestFeed(spark, "index", web), cache=cache)
    assert rc == 0 and "unchanged: 1" in text and len(calls(log)) == 6  # the index again, and the one text that isn't cached
    assert {r.source_file for r in M.load(spark, path).manifest.collect()} == {"a.md", "b.md"}
