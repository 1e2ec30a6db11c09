"""Operators on documents against brute force, and odd inputs: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritrove.llm import decontaminate, jaccard_join, license_scan, line_dedup, lm_scoring, packing, quality_rules, token_counts
from veritrove.llm import textvec as tv
from veritrove.plans.session import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, q string, _drop string, shard int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def frame(spark, texts, sources=None, ids=None):
    """Documents with further columns whose names the operators use inside."""
    rows = []
    for k, t in enumerate(texts):
        rows.append((ids[k] if ids else k, t, "en", sources[k] if sources else f"s{k % 3}", len(t or ""), 1, "q", "d", 2))
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(n))


ODD = [None, "", " \n\t ", "one", "One two", "a b c d e", "A B C D E", "a b c d e", "é ü 漢字 🙂 x", "x" * 50_000, "z " * 30_000]


def test_words_and_hashes():
    texts = ["Ab c\x0bd", None, "", "é É  ", "last"]
    s = next(tv.slices(pa.array(texts)))
    w = tv.words(s)
    got = [[bytes(w.data[a:z]).decode() for a, z in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first, w.first[1:])]
    assert got == [WORD.findall(lower(t or "")) for t in texts]
    assert tv.hashes(w)[-1].astype(np.int64) == tv.hash_of("last")
    many = [f"k{i}" for i in range(3000)]
    assert sum(len(x) for x in tv.slices(pa.array(many))) == 3000


def shingle_set(t, n=5):
    w = WORD.findall(lower(t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def near_copies(rng, n=160):
    """Families of texts with some words changed, some by a little too much, and texts around shared passages."""
    texts = []
    for size in (8, 30, 60, 200):
        base = prose(rng, size).split()
        for _ in range(n // 8):
            w = list(base)
            for _ in range(rng.integers(0, max(1, size // 12) + 1)):
                w[rng.integers(size)] = f"n{rng.integers(10**6)}"
            texts.append(" ".join(w))
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 40, 9000)} {passage} {prose(rng, int(rng.integers(1, 60)), 9000)}" for _ in range(n // 4)]
    return texts + [texts[0], texts[5].upper()]


def brute_links(texts):
    """For each text the number of other distinct sets that it is linked with."""
    kinds = {g for g in map(shingle_set, texts) if g}
    n = {g: sum(1 for h in kinds if h != g and 100 * len(g & h) >= 75 * len(g | h)) for g in kinds}
    return [n.get(shingle_set(t), 0) for t in texts]


def test_jaccard_components(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = ODD + near_copies(rng)
    d = frame(spark, texts)
    want, links = brute_components(list(enumerate(texts))), brute_links(texts)
    for bucket, sample, hot in ((3, 64, 64), (16, 1, 17)):  # small buckets, hot signatures
        monkeypatch.setattr(jaccard_join, "SMALL_BUCKET", bucket)
        monkeypatch.setattr(jaccard_join, "SAMPLE", sample)
        monkeypatch.setattr(jaccard_join, "HOT_COUNT", hot)
        monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 8 * 300)
        got = jaccard_join.jaccard_components(d).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert {r.doc_id: r.n_shingles for r in got} == {k: len(shingle_set(t)) for k, t in enumerate(texts)}
        assert {r.doc_id: r.n_links for r in got} == dict(enumerate(links))
    kept = {r.doc_id for r in jaccard_join.keep_one(d).collect()}
    assert kept == set(want.values())
    assert jaccard_join.keep_one(d).columns == d.columns


def test_links_of_large_families(spark, monkeypatch):
    """Families of 10 to 300 near copies, tight ones (all linked) and loose ones, are counted whole."""
    rng = np.random.default_rng(15)
    texts = []
    for size, most in ((10, 1), (17, 1), (30, 1), (60, 1), (60, 9), (300, 1), (120, 7)):
        base = prose(rng, 200, 5000).split()
        for _ in range(size):
            w = list(base)
            for at in rng.choice(200, int(rng.integers(1, most + 1)), replace=False):
                w[at] = f"n{rng.integers(10**9)}"
            texts.append(" ".join(w))
    texts += texts[:3]
    links, want = brute_links(texts), brute_components(list(enumerate(texts)))
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 8 * 8000)
    got = jaccard_join.jaccard_components(frame(spark, texts)).collect()
    assert {r.doc_id: r.n_links for r in got} == dict(enumerate(links))
    assert {r.doc_id: r.component_id for r in got} == want


def test_signatures_take_few_bytes_however_many_tasks():
    """What is sent is whole, and takes no more for each signature when it goes to a thousand tasks."""
    rng = np.random.default_rng(8)
    texts = pa.array([prose(rng, int(n)) for n in rng.integers(250, 900, 200)])
    sent = {}
    for tasks in (20, 1000):
        split = jaccard_join.split_of({3: 1e5, 4: 1e7, 5: 4e6}, tasks)
        assert tasks <= split.sum(0).max() <= tasks + 3
        n = size = 0
        for b in [pa.RecordBatch.from_arrays([texts], names=["text"])]:
            for fp, sizes, rows in jaccard_join._fresh_signatures(b, 5, 0.75, set()):
                sig, owner, band, spare, place = jaccard_join._flat(rows)
                want = sorted(zip((sig >> np.uint64(32)).tolist(), fp[owner].tolist(), sizes[owner].tolist(), band.tolist(), spare.tolist(), place.tolist()))
                got = []
                for out in jaccard_join._blobs(fp, sizes, rows, split, np.sort(sig)[:100]):
                    for pid, x in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                        assert 0 <= pid < split.sum(0).max()
                        (f, s, bd, sp, count), (g, pl, *_) = jaccard_join._unpacked(x)
                        got += zip(g.tolist(), *(np.repeat(c, count).tolist() for c in (f, s, bd, sp)), pl.tolist())
                        size += len(x)
                assert sorted(got) == want
                n += len(want)
        sent[tasks] = size / n
    assert sent[20] < 9 and sent[1000] < 17, sent


def test_written_leaves_no_shuffle_files(spark):
    """The files of a written table's shuffles go with it, not when the JVM collects them."""
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    t = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "freed")
    assert tracker.shuffleStatuses().size() <= before
    assert sum(r.n for r in t.collect()) == 1000


def test_spanning_joins_what_is_linked():
    rng = np.random.default_rng(3)
    for _ in range(50):
        links = rng.random((9, 7)) < 0.12
        a, b = np.arange(9), np.arange(100, 107)
        x, y = jaccard_join.spanning(links, a, b)

        def parts(edges):
            label = {k: k for k in [*a.tolist(), *b.tolist()]}
            for _ in label:
                for p, q in edges:
                    label[p] = label[q] = min(label[p], label[q])
            return label

        assert parts(list(zip(x.tolist(), y.tolist()))) == parts([(int(a[i]), int(b[j])) for i, j in np.argwhere(links)])


def test_jaccard_odd_rows(spark):
    d = frame(spark, ["a b c d e f", "a b c d e f", None, "a b c d e f", "x" * 9000], ids=[4, 4, None, None, 9])
    got = sorted(((r.doc_id, r.component_id, r.n_shingles) for r in jaccard_join.jaccard_components(d).collect()), key=str)
    assert got == sorted([(4, 4, 2), (4, 4, 2), (None, None, 0), (None, None, 2), (9, 9, 1)], key=str)
    assert jaccard_join.jaccard_components(d.limit(0)).count() == 0


def test_signatures_meet_at_the_limit():
    """Pairs of sets that differ as much as a link allows share a signature, for many sizes."""
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 7, 9, 13, 16, 21, 40, 64, 65, 100, 255, 257, 700):
        for _ in range(6):
            common = rng.integers(1, 2**63, n).astype(np.uint64)
            extra = int(np.floor(n / 0.75 - n))  # all on one side: |A & B| = n, |A | B| = n + extra
            split = int(rng.integers(0, extra + 1))
            more = rng.integers(1, 2**63, extra).astype(np.uint64)
            sides = [np.sort(np.r_[common, more[:split]]), np.sort(np.r_[common, more[split:]])]
            found = []
            for v in sides:
                rows = list(jaccard_join.signatures(v, np.zeros(len(v), np.int64), np.array([len(v)]), 0.75))
                found.append(set(np.concatenate([r[0] for r in rows]).tolist()))
            assert found[0] & found[1], (n, split)


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark):
    rng = np.random.default_rng(1)
    texts = ODD + ["a b c a b c a b c", "l#1\nl#1\n\n \nx <y>", "z " * 300, *(prose(rng, int(rng.integers(45, 200)), 60) for _ in range(40))]
    d = frame(spark, texts, ["bad" if k < 14 else "good" for k in range(len(texts))])
    got = {r.doc_id: r for r in quality_rules.quality_rules(d).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), t
        assert r.host_failed == (k < 14) and r.kept == (not r.base_failed and not r.host_failed)
    kept = quality_rules.keep_good(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}
    assert quality_rules.quality_rules(d.limit(0)).count() == 0
    one = frame(spark, [prose(rng, 80)] * 3, [None] * 3, [7, 7, None])
    assert [r.kept for r in quality_rules.quality_rules(one).collect()] == [True] * 3


def test_a_few_failures_do_not_reject_a_host(spark):
    rng = np.random.default_rng(2)
    texts = ["short"] + [prose(rng, 90, 5000) for _ in range(60)]
    d = frame(spark, texts, ["small", *("small" if k < 2 else f"h{k % 4}" for k in range(60))])
    assert not any(r.host_failed for r in quality_rules.quality_rules(d).collect())


def test_lm_scoring(spark):
    rng = np.random.default_rng(3)
    # words follow their like, so a model with contexts beats the unigram
    texts = [" ".join(f"{'ab'[k % 2]}{rng.integers(30)}" for _ in range(60)) for k in range(300)] + [None, "", "never seen", "a1 a1", "x" * 50_000, "z " * 30_000]
    d = frame(spark, texts)
    got = {r.doc_id: r for r in lm_scoring.score_texts(d).collect()}
    toks = [WORD.findall(lower(t or "")) + [None] for t in texts]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    c = Counter(x for t, h in zip(toks, held) if not h for x in t)
    n, v = sum(c.values()), len(c)
    for k, t in enumerate(toks):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t))
    out = [k for k in range(300) if held[k]]
    assert sum(got[k].score for k in out) > sum(got[k].base_score for k in out) * 0.88
    assert lm_scoring.score_texts(d.limit(0)).count() == 0
    assert lm_scoring.score_texts(frame(spark, ["x"], ids=[None])).first().held_out is False


def test_lm_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "TOP", 20)
    rng = np.random.default_rng(4)
    texts = [prose(rng, 50, 300) for _ in range(60)]
    d = frame(spark, texts + texts[:3], ids=[*range(60), 0, 1, 2])
    got = lm_scoring.score_texts(d).collect()
    toks = {k: WORD.findall(t) + [None] for k, t in enumerate(texts)}
    c = Counter(x for k, t in [*toks.items(), (0, toks[0]), (1, toks[1]), (2, toks[2])] if zlib.crc32(str(k).encode()) % 7 != 2 for x in t)
    n, v = sum(c.values()), len(c)
    for r in got:
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks[r.doc_id]))
        assert r.n_known == sum(c[x] > 0 for x in toks[r.doc_id])


def test_model_probabilities_sum_to_one():
    rng = np.random.default_rng(12)
    weights, starts = rng.random(40) * 50 + 1, np.r_[np.arange(12), 20, 21, 40]
    m = lm_scoring.LogBilinear(weights, starts, np.arange(14) == 13)  # 11 to 19 keep their shares
    m.begin()
    for _ in range(300):  # 5 follows 3, 30 follows 7
        c1 = rng.choice([3, 7], 64)
        m.train(np.where(c1 == 3, 5, 30), c1, rng.integers(0, 40, 64), rng)
    every = np.arange(40)
    p = {c: 10 ** m.log10(every, np.full(40, c), np.full(40, 9)).astype(float) for c in (0, 3, 7, 33)}
    assert all(abs(x.sum() - 1) < 1e-4 for x in p.values()) and p[3][5] > 0.5 > p[7][5] and p[7][30] > 0.5 > p[3][30]
    # against the definition: products one by one
    h = m.p["A"][7] + m.p["B"][9]
    assert h[-1] == 1  # the biases' place
    c = np.exp([m.p["C"][k] @ h for k in range(14)])
    w = np.exp([m.p["R"][x] @ h for x in range(21, 40)])
    assert p[7][15] == pytest.approx(c[11] / c.sum() * weights[15] / weights[11:20].sum(), rel=1e-3)
    assert p[7][30] == pytest.approx(c[13] / c.sum() * w[30 - 21] / w.sum(), rel=1e-3)


def test_shares_of_other_words(spark, monkeypatch):
    """What a tail's symbol stands for adds up to one: its words without a symbol, and one more for unseen words."""
    monkeypatch.setattr(lm_scoring, "MIN_COUNT", 4)
    monkeypatch.setattr(lm_scoring, "SINGLES", 8)
    rng = np.random.default_rng(13)
    texts = [prose(rng, 60, 300) for _ in range(20)]
    counts = lm_scoring.count_words(frame(spark, texts))
    v = lm_scoring.vocabulary(counts)
    c = Counter(w for t in texts for w in t.split())
    tails = {r["word"]: r["tail"] for r in counts.collect()}
    rest = Counter()
    for w, n in c.items():
        if n < 4:
            rest[tails[tv.hash_of(w)]] += n + 1
    assert np.allclose(10**v.rest, [rest[t] + 1 for t in range(lm_scoring.TAILS)])
    assert v.modelled == 20 + sum(n for n in c.values() if n >= 4) and v.total == 20 * 61 and v.kinds == len(c) + 1
    assert np.all(np.diff(v.starts) > 0) and len(v.weights) == v.starts[-1] and set(v.symbols) >= set(range(8))


def test_packing(spark):
    rng = np.random.default_rng(6)
    texts = ODD + [prose(rng, int(rng.integers(1, 900))) for _ in range(200)] + [prose(rng, 5000)]
    texts += [texts[20]] * 5
    d = frame(spark, texts, ["hot" if k % 3 == 0 else f"s{k}" for k in range(len(texts))])
    rows = packing.pack(d, capacity=1000, per_source=2).collect()
    n = {k: len(WORD.findall(t or "")) for k, t in enumerate(texts)}
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault((r.shard, r.bin_id), []).append(r)
    assert set(by) == set(n)
    for k, v in by.items():  # pieces are whole and in order
        v.sort(key=lambda r: r.piece)
        assert sum(r.n_tokens for r in v) == n[k] and [r.first_token for r in v] == [1000 * i for i in range(len(v))]
    for v in bins.values():
        assert sum(r.n_tokens for r in v) <= 1000 and sorted(r.place for r in v) == list(range(len(v)))
        keys = [tuple(WORD.findall(lower(texts[r.doc_id] or ""))) for r in v]
        assert len(set(keys)) == len(keys)
        assert Counter("hot" if r.doc_id % 3 == 0 else r.doc_id for r in v)["hot"] <= 2
    assert packing.pack(d.limit(0)).count() == 0
    twice = packing.pack(frame(spark, ["a b", "a b"], ids=[1, 1])).collect()
    assert len({(r.shard, r.bin_id) for r in twice}) == 2


def test_best_fit_takes_the_tightest_compatible_bin():
    # the large ones first: bin 0 has room for 25, bin 1 for 30, bin 2 for 40
    assert packing.best_fit([60, 70, 75, 25], [1, 2, 3, 4], [1, 2, 3, 4], 100, 9)[3] == (0, 1)
    assert packing.best_fit([60, 70, 75, 25], [1, 2, 3, 4], [1, 2, 3, 3], 100, 9)[3] == (1, 1)  # bin 0 has a copy
    assert packing.best_fit([60, 70, 75, 25], [1, 2, 2, 2], [1, 2, 3, 4], 100, 1)[3] == (2, 1)  # 0 and 1 have the source


def brute_pack(lengths, sources, clusters, capacity, per_source):
    """Best fit by its definition: of all bins that a piece fits in and may go to, that with the least room, the oldest of such."""
    bins, out = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        ok = [
            (capacity - sum(lengths[i] for i in b) - lengths[k], n) for n, b in enumerate(bins)
            if (left := capacity - sum(lengths[i] for i in b)) >= lengths[k] and (left or not lengths[k])
            and sum(sources[i] == sources[k] for i in b) < per_source and all(clusters[i] != clusters[k] for i in b)
        ]
        n = min(ok)[1] if ok else len(bins)
        if not ok:
            bins.append([])
        out[k] = (n, len(bins[n]))
        bins[n].append(k)
    return [out[k] for k in range(len(lengths))]


def test_best_fit_equals_brute_force():
    rng = np.random.default_rng(16)
    for case in range(40):
        n = int(rng.integers(1, 90))
        lengths = rng.integers(1, 12 if case % 2 else 100, n).tolist()  # many ties, and few
        sources, clusters = rng.integers(0, 6, n).tolist(), rng.integers(0, 30, n).tolist()
        per = int(rng.integers(1, 4))
        assert packing.best_fit(lengths, sources, clusters, 100, per) == brute_pack(lengths, sources, clusters, 100, per)


def brute_license(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    at = [(i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    texts = ODD[:9] + [
        "Released under the MIT License.", "x MIT\nlicense, the mit-License! Apache LICENSE y", "Licensed under CC BY-NC 4.0.", mit, "foo " * 50 + mit.upper() + " bar",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "the of license and public", "cc by cc by", "permission to use copy",
        "license " * 3000, *ODD[9:],
    ]
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[12].labels == got[13].labels == "mit" and got[12].base_labels == "" and got[12].score == 1
    assert got[14].labels == "gpl,gpl-3.0" and got[15].labels == "apache,apache-2.0" and got[11].labels == "cc-by,cc-by-nc"
    assert got[16].labels == got[18].labels == got[19].labels == "" and got[16].score == 0
    assert license_scan.license_scan(frame(spark, texts).limit(0)).count() == 0


def test_licenses_do_not_starve_each_other(spark):
    key = {}
    for label, _, wording in license_scan.TEMPLATES:
        key.setdefault(label, []).append(wording)
    both = [f"{key['mit'][1]} {prose(np.random.default_rng(1), 50)} {key[x][0]}" for x in ("apache-2.0", "gpl-3.0", "mpl-2.0")]
    both += [f"{key['bsd'][0]} {key['cc-by-nc'][0]}", " ".join(w for _, _, w in license_scan.TEMPLATES)]
    texts = both + [w for w in (key["apache-2.0"][0], key["gpl-3.0"][0], key["cc-by-nc"][0]) for _ in range(9)]
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan.license_scan(frame(spark, texts)).collect()}
    assert got[0] == {"apache", "apache-2.0", "mit"} and got[1] == {"gpl", "gpl-3.0", "mit"} and got[2] == {"mit", "mpl-2.0"}
    assert got[3] == {"bsd", "cc-by", "cc-by-nc"} and got[4] == set(key)


def test_every_licence_wording_gives_its_label(spark):
    texts = [w for _, _, w in license_scan.TEMPLATES] + [" ".join(w.split()[3:]) for _, _, w in license_scan.TEMPLATES]
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, texts)).collect()}
    for k, (label, phrase, wording) in enumerate(license_scan.TEMPLATES):
        assert label in got[k].labels.split(",") and got[k].score == 1
        n = len(wording.split())
        if n > 8 and phrase in texts[k + len(license_scan.TEMPLATES)]:  # its first words are cut off
            assert label in got[k + len(license_scan.TEMPLATES)].labels.split(",") and got[k + len(license_scan.TEMPLATES)].score >= (n - 3) / n - 1e-9


def test_decontamination(spark):
    rng = np.random.default_rng(8)
    items = [prose(rng, n, 3000) for n in (8, 20, 40, 90, 300)] + [None, "", "..."]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("score", F.lit(1))
    clean = [prose(rng, int(rng.integers(5, 600)), 3000) for _ in range(60)]
    texts = [*clean, *ODD]
    leaks = set()
    items.append("Élan ñu ß. " + " ".join(f"Ó{k}é" for k in range(30)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("score", F.lit(1))
    texts.append("x " * 9 + items[-1].upper())  # case is no matter in any script
    leaks.add((len(texts) - 1, len(items) - 1))
    for k in range(5):
        texts.append(f"{clean[k]} {items[k].upper()}, {clean[k + 9]}")
        leaks.add((len(texts) - 1, k))
        w = items[k].split()
        w[len(w) // 3] = "changed"
        if k > 1:
            texts.append(clean[k] + "\n" + "\n".join(w) + "\n" + prose(rng, 2000, 3000))
            leaks.add((len(texts) - 1, k))
        texts.append(" ".join(items[k].split()[: len(items[k].split()) // 3]))  # a third of it is no leak
    d = frame(spark, texts)
    got = decontaminate.find_leaks(d, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == leaks
    kept = decontaminate.drop_leaks(d, bench)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {k for k, _ in leaks}
    assert decontaminate.find_leaks(d, bench.limit(0)).count() == 0 and decontaminate.drop_leaks(d, bench.limit(0)).count() == len(texts)
    assert decontaminate.find_leaks(d.limit(0), bench).count() == 0


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    items = [prose(rng, 30, 900) for _ in range(9)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = frame(spark, [f"{prose(rng, 50, 900)} {x}" for x in items])
    one = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 4)
    assert one == {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, bench).collect()} == {(k, k) for k in range(9)}


def test_block_max_wand_equals_brute_force(monkeypatch):
    monkeypatch.setattr(decontaminate, "POSTINGS", 4)
    rng = np.random.default_rng(10)
    for _ in range(60):
        lists = []
        for _ in range(25):
            at = np.sort(rng.choice(120, int(rng.integers(0, 60)), replace=False)).tolist()
            impacts = rng.random(len(at)).tolist()
            lists.append((at, impacts, [max(impacts[a : a + 4]) for a in range(0, len(at), 4)]))
        bound = np.array([max(x[1], default=0) for x in lists])
        terms = sorted(rng.choice(25, 9, replace=False).tolist())
        total = Counter()
        for t in terms:
            for i, x in zip(*lists[t][:2]):
                total[i] += x
        for threshold in (0.5, 2.0, 3.0):
            got = decontaminate.block_max_wand(lists, terms, bound, threshold)
            assert {i: pytest.approx(s) for i, s in got} == {i: s for i, s in total.items() if s >= threshold}


def test_line_dedup(spark):
    sources, texts = [], []
    for k in range(40):
        sources.append(f"s{k % 20}" if k else None)
        lines = [f"own {k}", "everywhere", "", "few" if k % 20 < 7 else "many" if k % 20 < 9 else "rest", f"own {k}"]
        texts.append("\n".join(lines))
    texts += [None, "", "everywhere", "everywhere", "x" * 200_000 + "\neverywhere", "long line " * 20_000]
    sources += ["s1", "s1", "s2", "s2", "s3", "s3"]
    ids = [*range(42), 42, 42, 43, 44]
    d = frame(spark, texts, sources, ids)
    got = line_dedup.dedup_lines(d).collect()
    spread = {}
    for i, t, s in zip(ids, texts, sources):
        for x in set((t or "").split("\n")):
            if x.strip():
                spread.setdefault(x, set()).add(s or "")
    first = {}
    for i, t in zip(ids, texts):
        for x in (t or "").split("\n"):
            first[x] = min(first.get(x, i), i)
    out = Counter()
    for i, t in zip(ids, texts):
        kept = [x for x in (t or "").split("\n") if len(spread.get(x, ())) < 8 or first[x] == i]
        out[i, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), "\n".join(kept)] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == out
    stripped = line_dedup.strip_boilerplate(d)
    rows = {r.doc_id: r for r in stripped.collect()}
    assert stripped.columns == d.columns and 42 not in rows and rows[40].text is None and rows[0].text == texts[0]
    assert rows[5].n_chars == len(rows[5].text) and rows[5].q == "q"
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = np.random.default_rng(11)
    letters = list(" '  \n\t stmdrevl'l'reABcé漢🙂0123½²_-!?.<|endoftext|>") + ["<|endoftext|>", "'s", "'ve", " '"]
    texts = ODD + ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(400)] + ["=" * 700 + "é" * 300, "à　 b", "it's they'll I'D 'sand x''s"]
    d = frame(spark, texts)
    want = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    got = {r.doc_id: r for r in token_counts.count_tokens(d, path).collect()}
    for k, (t, w) in enumerate(zip(texts, want)):
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (len(w.ids), len((t or "").encode()), len(w.ids) > 512), t
    assert token_counts.count_tokens(d.limit(0), path).count() == 0


def test_chunk_maps_compose_wherever_a_piece_is_cut():
    import public_tokenizers

    t = token_counts.Transducer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(14)
    for _ in range(12):
        piece = "".join(rng.choice(list("abcdeinrst=-ü"), int(rng.integers(70, 700)))).encode()
        want = len(t.merged(piece)) if len(piece) < 300 else t.run(piece)[1]
        for size in (1, 3, 7, 64):
            assert t.scan([piece[k : k + size] for k in range(0, len(piece), size)]) == t.run(piece)
        cuts = sorted({0, len(piece), *rng.integers(1, len(piece), 9).tolist()})
        assert t.scan([piece[a:z] for a, z in zip(cuts, cuts[1:])])[1] == want == t.count(piece)


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_counts.tv, "hashes", lambda w: np.zeros(len(w.start), np.uint64))
    texts = ["the quick brown fox", "the thee thes", "xyzzy 12345"]
    assert token_counts.Counter(path).counts(texts).tolist() == [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
