"""Phrase mining against brute force and SQL, and odd rows."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from veritrove.llm import phrase_mining
from veritrove.llm.oracles import ORACLES
from veritrove.llm.phrase_mining import collocations


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(rows, least=10, most=3, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in found.items() for k in range(2, len(p)) for o in range(len(p) - k + 1) for q in [p[o : o + k]] if 100 * a >= covered * counts[q]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, _, x, y = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), x, y))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def texts(rng, n):
    vocabulary = ["en", "de", "und", *(f"W{i}" if i % 5 else f"é{i}漢" for i in range(37))]  # words called like languages too
    weights = 1 / np.arange(1, 41)
    out = []
    for _ in range(n):
        w = [str(x) for x in rng.choice(vocabulary, rng.integers(1, 60), p=weights / weights.sum())]
        if rng.random() < 0.4:
            w[rng.integers(len(w)) : 0] = ["In", "the", "Beginning"] if rng.random() < 0.7 else ["new", "york"]
        out.append("".join(x + str(rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "\r\n", "? "])) for x in w))
    return out


ODD = [(None, "en"), ("", None), (" \t\n.,", "en"), ("a a a a a a a a a a a a a", None), ("one", "x"), ("z " * 20_000, "long"), ("q" * 50_000, "en"), ("a b c " * 12, ""), ("a b c " * 12, "")]


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(t, [None, "en", "de", "en"][k % 4]) for k, t in enumerate(texts(rng, 400))] + ODD
    d = spark.createDataFrame([(t, x, 1, 2, "p") for t, x in rows], "text string, lang string, w1 int, f int, phrase string").repartition(5)
    want = brute(rows)
    assert len(want) > 100 and any(len(r[2].split()) == 3 for r in want)
    for words, bits in ((2_000_000, 26), (300, 15)):  # many blocks, and a bitmap that lets infrequent phrases through
        monkeypatch.setattr(phrase_mining, "BLOCK_WORDS", words)
        monkeypatch.setattr(phrase_mining, "FILTER_BITS", bits)
        assert sorted(map(tuple, collocations(d).collect())) == want
    assert sorted(map(tuple, collocations(d, 6, 4, 60, 15).collect())) == brute(rows, 6, 4, 60, 15)
    t = pa.table({"text": pa.array([t for t, _ in rows]), "lang": pa.array([x for _, x in rows])})
    con = duckdb.connect()
    con.register("documents", t)
    found = con.sql(ORACLES["op11_phrase_mining"])
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and sorted(found.fetchall()) == want


def test_empty(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000
    one = spark.createDataFrame([(1, "en", "a", big), (2, "en", "b", big + 7)], "w1 long, lang string, phrase string, f long")
    two = spark.createDataFrame([(1, 2, big - 3)], "w1 long, w2 long, f long")
    row = phrase_mining._scored({1: one, 2: two}, 50).collect()[0]
    assert row.score == 1_000_000 * (big - 3) ** 2 // (big * (big + 7)) and (row.a, row.l, row.r) == (big - 3, big, big + 7)
