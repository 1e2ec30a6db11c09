"""Passages: spans of code points that follow paragraphs and sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.functions.text import content_hash, lf, passage_id

_BLANK_LINE = re.compile(r"\n[ \t]*\n+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def _between(pattern: re.Pattern, text: str, keep_gap: bool) -> Iterator[tuple[int, int]]:
    """Start and end of the parts between matches; with keep_gap a part takes the match after it along."""
    at = 0
    for m in pattern.finditer(text):
        end = m.end() if keep_gap else m.start()
        if end > at:
            yield at, end
        at = m.end()
    if at < len(text):
        yield at, len(text)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Offset and length of sentences, with the white space that follows them."""
    return [(a, z - a) for a, z in _between(_SENTENCE_END, text, True)]


def _packed(text: str, base: int, most: int) -> Iterator[tuple[int, int]]:
    """Sentences of a long paragraph, as many together as fit; longer ones are cut."""
    pieces = []
    for a, z in _between(_SENTENCE_END, text, True):
        pieces += [(a, z, False)] if z - a <= most else [(k, min(k + most, z), True) for k in range(a, z, most)]
    held: list[int] = []
    for a, z, cut in pieces:
        if held and (cut or z - held[0] > most):
            yield base + held[0], base + held[1]
            held = []
        if cut:
            yield base + a, base + z
        else:
            held = [held[0] if held else a, z]
    if held:
        yield base + held[0], base + held[1]


def chunk_text(text: str, least: int = 200, most: int = 3200) -> list[tuple[int, int]]:
    """Offset and length of each passage.

    Paragraphs of least to most characters stand alone; shorter ones are joined
    forward until they reach least; longer ones are packed by sentence."""
    if not text or not text.strip():
        return []
    out: list[tuple[int, int]] = []
    open_span: tuple[int, int] | None = None
    for a, z in _between(_BLANK_LINE, text, False):
        alone = z - a >= least
        if open_span and (alone or z - open_span[0] > most):
            out.append(open_span)
            open_span = None
        if z - a > most:
            out.extend(_packed(text[a:z], a, most))
        elif alone:
            out.append((a, z))
        else:
            open_span = (open_span[0] if open_span else a, z)
            if open_span[1] - open_span[0] >= least:
                out.append(open_span)
                open_span = None
    if open_span:
        out.append(open_span)
    return [(a, z - a) for a, z in out]


def passages(sources: DataFrame, least: int = 200, most: int = 3200) -> DataFrame:
    """source_file, char_offset, char_length, text, content_hash, passage_id of every passage of sources (source_file, text)."""

    @F.pandas_udf("array<struct<off:int,len:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"off": a, "len": n} for a, n in chunk_text(t, least, most)])

    s = sources.select("source_file", lf(F.coalesce("text", F.lit(""))).alias("full"))
    p = s.select("source_file", "full", F.explode(spans("full")).alias("s"))
    p = p.select("source_file", F.col("s.off").alias("char_offset"), F.col("s.len").alias("char_length"), F.expr("substring(full, s.off + 1, s.len)").alias("text"))
    return p.withColumns({"content_hash": content_hash("text"), "passage_id": passage_id("source_file", "char_offset", "char_length")})
