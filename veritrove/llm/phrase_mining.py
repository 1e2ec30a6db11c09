"""Phrase collocations by vertical positional inverted lists.

One pass cuts the texts into blocks of words and turns each into a vertical index: for every word the ascending list of
its positions. Positions jump by one more between pieces and texts, so words at neighbouring positions are neighbours in
a piece. Phrases grow level by level: the ends of the occurrences of phrases of k words are merge-joined with
those of the phrases of k words that end one position later, which share k - 1 words with them, and the joined list is
that of a phrase of k + 1 words; its length is the phrase's exact frequency in the block, and sums over blocks
are its frequency. Only lists of phrases frequent over the whole corpus are extended, as no phrase is
more frequent than its parts. Blocks look that up in a bitmap of fixed size by hash: a bit shared by two phrases lets through
one too many, whose count then doesn't reach the least frequency.

A word's key is a 64-bit hash of its language and its bytes, so languages never mix and no key holds a whole language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrove.llm import textvec as tv
from veritrove.plans.session import written

MIN_COUNT, MOST_WORDS, COVERED_PERCENT, TOP = 10, 3, 50, 2000
#: Words of a block, and blocks of a file.
BLOCK_WORDS, FILE_BLOCKS = 250_000, 4
#: Bits of the bitmap of frequent phrases (8 MB). With very many frequent phrases it passes more candidates, never fewer.
FILTER_BITS = 26
SALTS = 64

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_INSIDE = ~_ENDS
_INSIDE[[0x20, 0x09]] = False
_INDEX = "terms binary, langs binary, names array<string>, words binary, edges binary, counts binary, positions binary"


def _joined(chunks: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(chunks) if chunks else np.zeros(0, np.int64)


class _Block:
    """Words of consecutive texts, until there are enough for an index."""

    def __init__(self):
        self.keys, self.lang, self.position, self.start, self.end, self.data = [], [], [], [], [], []
        self.names: dict[str, int] = {}
        self.salts: list[int] = []  # a hash of each name
        self.next, self.bytes, self.size = 0, 0, 0

    def add(self, s: tv.Slice, langs: list[str]) -> None:
        w = tv.words(s, True, _INSIDE)
        if not len(w.start):
            return
        text = np.repeat(np.arange(len(s)), w.counts)
        piece = np.cumsum(_ENDS[w.data])[w.start]
        new = np.zeros(len(text), np.int64)
        new[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
        position = np.arange(len(text)) + np.cumsum(new) + self.next
        self.next = int(position[-1]) + 2
        code = np.array([self.names.setdefault(x, len(self.names)) for x in langs], np.int32)[text]
        self.salts += [tv.hash_of(x) for x in [*self.names][len(self.salts) :]]
        # languages are hashed once more: words may be called like languages
        salt = tv.mix(tv.mix(np.array(self.salts, np.int64).astype(np.uint64)) + np.uint64(1))
        self.keys.append(tv.mix(tv.hashes(w) ^ salt[code]))
        self.lang.append(code)
        self.position.append(position)
        self.start.append(w.start + self.bytes)
        self.end.append(w.end + self.bytes)
        self.data.append(w.data)
        self.bytes += len(w.data)
        self.size += len(text)

    def index(self) -> pa.RecordBatch:
        """One row: words in order of their keys, and all their positions one list after the other."""
        keys, lang, start, data = _joined(self.keys), _joined(self.lang), _joined(self.start), np.concatenate(self.data)
        terms, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        positions = _joined(self.position)[np.argsort(inverse, kind="stable")]
        length = _joined(self.end)[first] - start[first]
        edges = np.r_[0, np.cumsum(length)]
        words = data[np.repeat(start[first] - edges[:-1], length) + np.arange(edges[-1])]
        row = [terms, lang[first].astype(np.int32), None, words, edges.astype(np.int32), counts.astype(np.int32), positions.astype(np.int32)]
        arrays = [pa.array([list(self.names)], pa.list_(pa.string())) if x is None else pa.array([x.tobytes()], pa.binary()) for x in row]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _INDEX.split(", ")])


def positional_index(docs: DataFrame) -> DataFrame:
    """Rows of vertical lists, one for each block of BLOCK_WORDS words or what a task has, of docs (text, lang)."""
    most = BLOCK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for b in batches:
            langs = b.column("lang").to_pylist()
            for s in tv.slices(b.column("text")):
                block.add(s, langs[s.lo : s.lo + len(s)])
                if block.size >= most:
                    yield block.index()
                    block = _Block()
        if block.size:
            yield block.index()

    return docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(run, _INDEX)


def _column(b: pa.RecordBatch, name: str, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(b.column(name)[row].as_buffer(), kind)


def _word_counts(index: DataFrame) -> DataFrame:
    """w1 (key), lang, phrase (the word), f of every word, infrequent ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                terms, counts = _column(b, "terms", k, np.int64), _column(b, "counts", k, np.int32)
                names = b.column("names")[k].values
                words = pa.Array.from_buffers(pa.string(), len(terms), [None, b.column("edges")[k].as_buffer(), b.column("words")[k].as_buffer()])
                langs = names.take(pa.array(_column(b, "langs", k, np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(terms), langs, words, pa.array(counts.astype(np.int64))], names=["w1", "lang", "phrase", "c"])

    found = index.select("terms", "langs", "names", "words", "edges", "counts").mapInArrow(run, "w1 long, lang string, phrase string, c long")
    return found.groupBy("w1", "lang", "phrase").agg(F.sum("c").alias("f"))


def _keys(k: int) -> list[str]:
    return [f"w{i}" for i in range(1, k + 1)]


def _bit(columns: list[str]) -> Column:
    """The bit of a phrase: its words' keys, rotated and combined."""
    turn = lambda a, w: F.shiftleft(a, 13).bitwiseOR(F.shiftrightunsigned(a, 51)).bitwiseXOR(F.col(w))
    return reduce(turn, columns[1:], F.col(columns[0])).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def _bits(parts: list[np.ndarray], size: int) -> np.ndarray:
    """The same of arrays of keys, for a bitmap of so many bits."""
    turn = lambda a, w: (a << np.uint64(13) | a >> np.uint64(51)) ^ w
    return reduce(turn, parts[1:], parts[0]) & np.uint64(size - 1)


def _filter(frequent: DataFrame, k: int) -> bytes:
    """The bitmap of frequent phrases of k words: 2**FILTER_BITS bits, however many phrases there are."""
    bit = frequent.select(_bit(_keys(k)).alias("bit"))
    chunks = bit.groupBy(F.expr("bit >> 15").alias("chunk")).agg(F.expr("bitmap_construct_agg(bit & 32767)").alias("bits"))
    out = np.zeros((max(1, 1 << (FILTER_BITS - 15)), 4096), np.uint8)
    for r in chunks.collect():  # 2**(FILTER_BITS - 15) rows at most
        out[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _holds(bitmap: bytes, parts: list[np.ndarray]) -> np.ndarray:
    at = _bits(parts, 8 * len(bitmap))
    return (np.frombuffer(bitmap, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _extended(terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, frequent: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The phrases of one word more than the last of `frequent` has: their words' keys, and the lengths of their lists.

    frequent: the bitmaps of the frequent phrases of 1, 2, ... words."""
    term = np.repeat(np.arange(len(terms), dtype=np.int32), counts)
    order = np.argsort(positions)
    ends, term = positions[order], term[order]
    kind, parts, sizes = term, [terms], counts  # of each occurrence its phrase; of each phrase its words and frequency here
    for k, bitmap in enumerate(frequent):
        known = _holds(bitmap, parts)[kind]
        ends, term, kind = ends[known], term[known], kind[known]
        # both lists are in order of position, so the ends one later stand next to the ends
        at = np.flatnonzero(ends[1:] == ends[:-1] + 1) + 1
        both = kind[at - 1].astype(np.int64) * len(terms) + term[at]
        ends, term = ends[at], term[at]
        if k + 1 < len(frequent):
            pair, kind, sizes = np.unique(both, return_inverse=True, return_counts=True)
            kind = kind.astype(np.int32)
        else:  # phrases by occurrence aren't asked for any more
            pair, sizes = np.unique(both, return_counts=True)
        before, after = np.divmod(pair, max(1, len(terms)))
        parts = [*(p[before] for p in parts), terms[after]]
    return parts, sizes


def _phrase_counts(index: DataFrame, frequent: list[bytes]) -> DataFrame:
    """w1, ... and f of the phrases of len(frequent) + 1 words, each part of which is frequent."""
    k = len(frequent) + 1
    bitmaps = index.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                parts, sizes = _extended(_column(b, "terms", row, np.uint64), _column(b, "counts", row, np.int32), _column(b, "positions", row, np.int32), bitmaps.value)
                arrays = [pa.array(p.astype(np.int64)) for p in parts] + [pa.array(sizes.astype(np.int32))]
                for at in range(0, len(sizes), 65_536):
                    yield pa.RecordBatch.from_arrays([a.slice(at, 65_536) for a in arrays], names=[*_keys(k), "c"])

    found = index.select("terms", "counts", "positions").mapInArrow(run, ", ".join(f"{w} long" for w in _keys(k)) + ", c int")
    return found.groupBy(*_keys(k)).agg(F.sum("c").alias("f"))


def _frequent(index: DataFrame, words: DataFrame, least: int, most_words: int) -> dict[int, DataFrame]:
    """Frequent phrases by their number of words: w1, ..., f, and words with lang and phrase."""
    levels, bitmaps = {1: words.where(F.col("f") >= least)}, []
    for k in range(2, most_words + 1):
        bitmaps.append(_filter(levels[k - 1], k - 1))
        levels[k] = written(_phrase_counts(index, bitmaps).where(F.col("f") >= least), f"phrases-{k}")
    return levels


def _part(level: DataFrame, first: int, size: int, names: dict[str, str]) -> DataFrame:
    """A level's rows by the words first, ..., first + size - 1 of longer phrases."""
    return level.select(*(F.col(f"w{i + 1}").alias(f"w{first + i}") for i in range(size)), *(F.col(a).alias(b) for a, b in names.items()))


def _scored(levels: dict[int, DataFrame], covered: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one covers."""
    named, out = {1: levels[1]}, None
    for k in range(2, max(levels) + 1):
        d = levels[k]
        for j in range(1, k):  # cut after j words
            left, right = {"f": f"l{j}"}, {"f": f"r{j}"}
            if j == k - 1:
                left |= {"lang": "lang", "phrase": "head"}
                right |= {"phrase": "tail"}
            d = d.join(_part(named[j], 1, j, left), [f"w{i}" for i in range(1, j + 1)])
            d = d.join(_part(named[k - j], j + 1, k - j, right), [f"w{i}" for i in range(j + 1, k + 1)])
        d = d.withColumn("phrase", F.concat_ws(" ", "head", "tail"))
        # decimals: a * a * 1000000 may pass 64 bits
        exact = lambda j: F.expr(f"cast(f as decimal(19,0)) * cast(f as decimal(19,0)) * 1000000 div (cast(l{j} as decimal(19,0)) * cast(r{j} as decimal(19,0)))")
        cuts = [F.struct(exact(j).alias("score"), F.lit(j).alias("cut"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")) for j in range(1, k)]
        d = d.withColumn("best", F.least(*cuts) if k > 2 else cuts[0])
        named[k] = d.select(*_keys(k), "lang", "phrase", "f", "best")
        if k < max(levels):
            named[k] = written(named[k], f"named-{k}")
    for k in range(2, max(levels) + 1):
        d = named[k]
        inside = [levels[m].select(*(F.col(f"w{o + i}").alias(f"w{i}") for i in range(1, k + 1)), "f") for m in range(k + 1, max(levels) + 1) for o in range(m - k + 1)]
        if inside:
            longest = reduce(DataFrame.union, inside).groupBy(*_keys(k)).agg(F.max("f").alias("longer"))
            d = d.join(longest, _keys(k), "left").where(F.expr(f"longer is null or 100 * longer < {covered} * f"))
        d = d.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score")
        out = d if out is None else out.union(d)
    return out


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS, covered: int = COVERED_PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score (long): each language's `top` phrases of two to most_words words.

    docs has text and lang; other columns are ignored. A-Z are lower-cased, texts cut into pieces at .,;:!? and line ends and
    these into words at spaces and tabs. n is the number of words of the language, a the phrase's frequency (min_count at least),
    score the least of floor(10^6 a a / (l r)) over the cuts into two parts with frequencies l and r; of equal ones the
    shortest first part counts. A phrase inside a longer candidate with `covered` percent of its frequency or more goes.
    Order: score, a (descending), phrase by bytes, which leaves no ties. A null language is `und`; null and empty texts have no
    words; repeated rows count each; texts may be of any length; an empty table gives an empty result."""
    if most_words < 2 or min_count < 1:
        raise ValueError("phrases have two words at least and occur")
    # small files: what a task reads, and Arrow sends on at once, is a few blocks
    index = written(positional_index(docs), "positions", maxRecordsPerFile=FILE_BLOCKS)
    words = written(_word_counts(index), "words")
    found = _scored(_frequent(index, words, min_count, most_words), covered)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language may hold most candidates: first the best of each of its shares
    share = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    share = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= top)
    ranked = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
