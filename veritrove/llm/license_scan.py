"""Licence scans with a positional rare-token index, in DataFrame functions only.

The index is a fixed table: template word -> (template, place). The two
highest-IDF words of each template's mandatory key phrase (IDF from document
counts over the whole corpus) are looked up in every file, their postings and
the words' places in the file are intersected by relative position, and
alignments on which at least two postings agree are verified by the key phrase
and by the template's share of words in place. An alignment that can be
verified has the whole key phrase in place, so both words vote for it: none is
missed, however long the file or however many licences are in it.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that give a label wherever they stand.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Fixed values: (label, mandatory key phrase, wording) from public licence texts and their usual notices.
TEMPLATES = (
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by", "cc by", "licensed under cc by"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("mit", "the software is provided as is without warranty of any kind", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "the above copyright notice and this permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "this software is provided by the copyright holders and contributors as is", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "the software is provided as is and the author disclaims all warranties", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "without even the implied warranty of merchantability or fitness", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("zlib", "in no event will the authors be held liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "boost software license", "distributed under the boost software license version 1 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal", "this work is dedicated to the public domain under cc0 1 0 universal"),
)
#: Template words that must be in place, as a share.
MIN_SHARE = 0.6
VOCABULARY = sorted({w for _, _, t in TEMPLATES for w in t.split()})

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, UPPER.lower()), NOT_WORD), lambda x: x != "")


def _key_words() -> list[str]:
    """For each key phrase or base phrase the word that the fewest of them share with prose: its longest."""
    return sorted({max(k.split(), key=len) for k in [*BASE_PHRASES, *(k for _, k, _ in TEMPLATES)]})


def word_counts(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Documents, and documents with each word of the templates. One row for each of the fixed words comes to the driver."""
    vocabulary = F.array(*map(F.lit, VOCABULARY))
    has = F.array_intersect(vocabulary, _words(F.coalesce("text", F.lit(""))))
    # outer: else the optimiser tests the array's size first, and takes the words twice
    counts = docs.select(F.explode_outer(has).alias("word")).where("word is not null").groupBy("word").count()
    return docs.count(), {r["word"]: r["count"] for r in counts.collect()}


def _at(words: str, i: Column, phrase: str, shift: int = 0) -> Column:
    """Whether the phrase stands in words from place i + shift."""
    tests = [F.coalesce(F.get(words, i + (k + shift)) == w, F.lit(False)) for k, w in enumerate(phrase.split())]
    return functools.reduce(lambda a, b: a & b, tests)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Null texts count as empty: no words, no labels (''), score 0. score is the
    highest share of a verified template's words that are in place, and 0.5 at least where
    a base phrase was found. Phrases may repeat; each place counts. Texts may be of any length.
    Repeated rows are scanned each; extra columns are ignored; an empty table gives an empty result."""
    n_docs, df = word_counts(docs)
    idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) for w in VOCABULARY}
    rare = [sorted(set(key.split()), key=lambda w: (-idf[w], w))[:2] for _, key, _ in TEMPLATES]
    keys = "|".join(_key_words())
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("t"))
    none = F.array().cast("array<string>")
    maybe = F.col("t").rlike(f"(?i)({keys})") | F.col("t").rlike("(?i)cc")
    d = d.select(
        "doc_id",
        F.regexp_count("t", F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"),
        F.when(maybe, _words(F.col("t"))).otherwise(none).alias("w"),
    )
    places = F.filter(
        F.transform("w", lambda w, i: F.struct(
            i.alias("i"),
            functools.reduce(lambda a, p: a.when((w == p.split()[0]) & _at("w", i, p), BASE_PHRASES[p]), BASE_PHRASES, F.when(F.lit(False), F.lit(""))).alias("label"),
        )),
        lambda x: x.label.isNotNull(),
    )
    d = d.withColumn("base", places)
    # votes: template and the place in the file where its first word would stand
    posting = [(w, k, p) for k, (_, _, t) in enumerate(TEMPLATES) for p, w in enumerate(t.split()) if w in rare[k]]
    by_word: dict[str, list[tuple[int, int]]] = {}
    for w, k, p in posting:
        by_word.setdefault(w, []).append((k, p))
    index = F.create_map(*(x for w, v in by_word.items() for x in (F.lit(w), F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in v)))))
    found = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x.w.isin(list(by_word)))
    votes = F.flatten(F.transform(found, lambda x: F.transform(F.element_at(index, x.w), lambda y: F.struct(y.k.alias("k"), (x.i - y.p).alias("at")))))
    d = d.withColumn("v", F.array_sort(votes))
    # sorted votes: an alignment with two votes or more begins where the next one is equal and the last one isn't
    agreed = F.filter("v", lambda x, i: (x == F.get("v", i + 1)) & ((i == 0) | (x != F.get("v", i - 1))))
    d = d.withColumn("a", agreed)

    def share(at: Column, k: int) -> Column:
        words = TEMPLATES[k][2].split()
        skip = F.greatest(-at, F.lit(0))  # of a wording that would begin before the file
        here = F.slice("w", at + skip + 1, F.lit(len(words)) - skip)
        hit = F.filter(F.zip_with(here, F.slice(F.array(*map(F.lit, words)), skip + 1, F.lit(len(words)) - skip), lambda a, b: a == b), lambda x: x)
        return F.size(hit) / F.lit(float(len(words)))

    def key_at(at: Column, k: int) -> Column:
        _, key, wording = TEMPLATES[k]
        words, part = wording.split(), key.split()
        shift = next(j for j in range(len(words)) if words[j : j + len(part)] == part)
        return _at("w", at, key, shift)

    def verdict(x: Column) -> Column:
        out = F.when(F.lit(False), F.lit(0.0))
        for k in range(len(TEMPLATES)):
            out = out.when((x.k == k) & key_at(x.at, k), share(x.at, k))
        return F.struct(x.k.alias("k"), F.coalesce(out, F.lit(0.0)).alias("share"))

    d = d.withColumn("m", F.filter(F.transform("a", verdict), lambda x: x.share >= MIN_SHARE))
    names = F.array(*(F.lit(label) for label, _, _ in TEMPLATES))
    base = F.array_distinct(F.transform("base", lambda x: x.label))
    own = F.transform("m", lambda x: F.element_at(names, x.k + 1))
    floor = F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.get(F.transform("base", lambda x: x.i), F.lit(0)).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x.i)).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.greatest(floor, F.coalesce(F.array_max(F.transform("m", lambda x: x.share)), F.lit(0.0))).alias("score"),
    )
