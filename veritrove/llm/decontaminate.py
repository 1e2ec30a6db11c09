"""Benchmark decontamination: a BM25 index of the test items, queried with every passage of the corpus.

Test items are the indexed side. Their BM25 impacts, with IDF from document
counts over the whole corpus, are divided by the item's score against itself,
so a passage that holds all of an item's words scores 1 whatever its length.
Passages are windows of twice the longest item, half overlapping, so each
item-long stretch of a document lies whole in one of them. A window whose
summed upper bounds stay under the threshold is passed over at once, and so is
one whose summed maxima stay under it in every group of items; the others are
run through block-max WAND, which retrieves all items at or above
it. Retrieved items are verified: enough of the question's word pairs and
enough of the answer's words must occur in the window (answers are short, so
one changed word would take most of their pairs).

The items are taken in blocks of bounded size, each broadcast in turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.llm import textvec as tv

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach; of the question's word pairs and the answer's words that must occur in it.
THRESHOLD, QUESTION_SHARE, ANSWER_SHARE = 0.5, 0.4, 0.5
#: Items and words in a block of items; postings in a block of a posting list.
BLOCK_ITEMS, BLOCK_WORDS, POSTINGS = 20_000, 2_000_000, 32
#: Numbers in an index's table of group maxima, at most.
GROUP_CELLS = 4_000_000

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Item:
    item_id: int
    words: list[int]
    question: frozenset
    answer: frozenset


def _grams(words: list[int]) -> frozenset:
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(words)


def _slices(texts: pa.Array) -> Iterator[tv.Slice]:
    """Slices of the texts in lower case, of any script."""
    for at in range(0, len(texts), tv.SLICE_TEXTS):
        for s in tv.slices(pc.utf8_lower(texts.slice(at, tv.SLICE_TEXTS).cast(pa.large_string()))):
            s.lo += at
            yield s


def item_of(item_id: int, text: str | None) -> Item:
    """The answer is what follows an 'answer:' mark, else the last sentence, else the last quarter of the words."""
    s = next(_slices(pa.array([text or ""])))
    w = tv.words(s, is_word=WORD_BYTES)
    h = tv.hashes(w).tolist()
    body = s.data.tobytes().decode().rstrip()
    mark = [m.end() for m in re.finditer(r"\banswer\s*:", body)] or [m.end() for m in re.finditer(r"[.?!]\s+", body)]
    split = len(h) - max(1, len(h) // 4)
    if mark:
        byte = len(body[: mark[-1]].encode())
        split = int(np.searchsorted(w.start, byte))
    split = min(max(split, 1), max(len(h) - 1, 0))
    return Item(item_id, h, _grams(h[:split] or h), frozenset(h[split:] or h))


@dataclass
class Index:
    """Items of one length class. Words are numbered by their place in `vocabulary`."""

    longest: int
    items: list[Item]
    vocabulary: np.ndarray
    bound: np.ndarray = field(default=None)
    postings: list[tuple[list[int], list[float], list[float]]] = field(default=None)
    groups: np.ndarray = field(default=None)  # for each word its largest impact in each group of neighbouring items

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        """Sets impacts, bounds and block maxima; df in the order of the vocabulary."""
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        mean = sum(len(i.words) for i in self.items) / len(self.items)
        lists: list[tuple[list[int], list[float], list[float]]] = [([], [], []) for _ in self.vocabulary]
        for k, item in enumerate(self.items):
            w, tf = np.unique(np.searchsorted(self.vocabulary, np.array(item.words, np.uint64)), return_counts=True)
            impact = idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(item.words) / mean))
            for x, y in zip(w.tolist(), (impact / impact.sum()).tolist()):
                lists[x][0].append(k)
                lists[x][1].append(y)
        for _, impacts, best in lists:
            best.extend(max(impacts[a : a + POSTINGS]) for a in range(0, len(impacts), POSTINGS))
        self.postings = lists
        self.bound = np.array([max(x[1], default=0.0) for x in lists])
        n = max(1, min(-(-len(self.items) // 4), GROUP_CELLS // max(1, len(lists))))
        self.groups = np.zeros((len(lists), n), np.float32)
        for w, (at, impacts, _) in enumerate(lists):
            np.maximum.at(self.groups[w], np.array(at, np.int64) * n // len(self.items), np.array(impacts, np.float32))


def block_max_wand(postings: list[tuple[list[int], list[float], list[float]]], terms: list[int], bound: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """(item, score) of all items whose summed impacts over the terms reach the threshold."""
    cursors = [[postings[t][0][0], 0, postings[t], float(bound[t])] for t in terms if postings[t][0]]
    found = []
    slack = threshold - 1e-9
    while cursors:
        cursors.sort(key=lambda c: c[0])
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += c[3]
            if total >= slack:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        upper, jump = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
        for c in cursors[: pivot + 1]:  # shallow: the blocks that would hold the item
            items, _, best = c[2]
            at = c[1] // POSTINGS
            while at < len(best) and items[min((at + 1) * POSTINGS, len(items)) - 1] < item:
                at += 1
            if at < len(best):
                upper += best[at]
                jump = min(jump, items[min((at + 1) * POSTINGS, len(items)) - 1] + 1)
        if upper >= slack:
            score = 0.0
            for c in cursors[: pivot + 1]:
                items, impacts, _ = c[2]
                while c[1] < len(items) and items[c[1]] < item:
                    c[1] += 1
                if c[1] < len(items) and items[c[1]] == item:
                    score += impacts[c[1]]
                    c[1] += 1
            if score >= slack:
                found.append((item, score))
        else:
            goal = max(item + 1, jump) if jump > item else item + 1
            for c in cursors[: pivot + 1]:
                items = c[2][0]
                while c[1] < len(items) and items[c[1]] < goal:
                    c[1] += 1
        alive = []
        for c in cursors:
            if c[1] < len(c[2][0]):
                c[0] = c[2][0][c[1]]
                alive.append(c)
        cursors = alive
    return found


def index_blocks(benchmark: DataFrame) -> Iterator[list[Index]]:
    """Indexes by length class (powers of two), a block of items at a time, in the order of item_id."""
    block: list[Item] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id").toLocalIterator()
    for item_id, text in rows:
        item = item_of(item_id, text)
        if not item.words:
            continue
        if block and (len(block) >= BLOCK_ITEMS or size + len(item.words) > BLOCK_WORDS):
            yield _classes(block)
            block, size = [], 0
        block.append(item)
        size += len(item.words)
    if block:
        yield _classes(block)


def _classes(items: list[Item]) -> list[Index]:
    by: dict[int, list[Item]] = {}
    for i in items:
        by.setdefault(max(4, (len(i.words) - 1).bit_length()), []).append(i)
    return [Index(max(len(i.words) for i in v), v, np.unique(np.array([w for i in v for w in i.words], np.uint64))) for _, v in sorted(by.items())]


class Lookup:
    """Numbers of word hashes in a sorted vocabulary, -1 for others."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        ok = self.vocabulary[at] == h[maybe]
        out[maybe[ok]] = at[ok]
        return out


def _document_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Documents, and documents with each word of the block's vocabulary."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        look = Lookup(shared.value)
        total, n = np.zeros(len(shared.value), np.int64), 0
        for b in batches:
            for s in _slices(b.column(0)):
                w = tv.words(s, is_word=WORD_BYTES)
                at = look(tv.hashes(w))
                text = np.repeat(np.arange(len(s)), w.counts)
                hit = at >= 0
                pair = np.unique(text[hit] * len(total) + at[hit])
                total += np.bincount(pair % len(total), minlength=len(total))
                n += len(s)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[n, total[some]])], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # as many rows as the block has words
    df, n_docs = np.zeros(len(vocabulary)), 0
    for r in rows:
        if r["word"] < 0:
            n_docs = r["n"]
        else:
            df[r["word"]] = r["n"]
    return n_docs, df


def _prepared(docs: DataFrame, indexes: list[Index]):
    """The block's indexes with weights, broadcast."""
    vocabulary = np.unique(np.concatenate([x.vocabulary for x in indexes]))
    n_docs, df = _document_counts(docs, vocabulary)
    for x in indexes:
        x.weigh(max(n_docs, 1), df[np.searchsorted(vocabulary, x.vocabulary)])
    return docs.sparkSession.sparkContext.broadcast((vocabulary, indexes))


def _leaks(texts: pa.Array, look: Lookup, indexes: list[Index], local: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(row, item_id, score, question share, answer share, first word) of the leaks in a batch, the best window for each item."""
    for s in _slices(texts):
        w = tv.words(s, is_word=WORD_BYTES)
        h = tv.hashes(w)
        at = look(h)
        best: dict[tuple[int, int], tuple] = {}
        for x, to in zip(indexes, local):
            number = np.where(at >= 0, to[at], -1)
            bound = np.append(x.bound, 0.0)[number]
            total = np.zeros(len(h) + 1)
            np.cumsum(bound, out=total[1:])
            n_windows = np.maximum(1, -(-w.counts // x.longest) - 1) * (w.counts > 0)
            row = np.repeat(np.arange(len(s)), n_windows)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
            start = w.first[row] + k * x.longest
            end = np.minimum(start + 2 * x.longest, w.first[row + 1])
            for j in np.flatnonzero(total[end] - total[start] >= threshold - 1e-6).tolist():
                a, z, r = int(start[j]), int(end[j]), int(row[j])
                terms = np.unique(number[a:z])
                terms = terms[terms >= 0]
                if x.groups[terms].sum(0).max() < threshold - 1e-4:
                    continue
                found = block_max_wand(x.postings, terms.tolist(), x.bound, threshold)
                if not found:
                    continue
                seq = h[a:z].tolist()
                grams = set(zip(seq, seq[1:])) | set(seq)
                for k2, score in found:
                    item = x.items[k2]
                    q = len(item.question & grams) / len(item.question)
                    n = len(item.answer & grams) / len(item.answer)
                    if q >= QUESTION_SHARE and n >= ANSWER_SHARE:
                        key = (r + s.lo, item.item_id)
                        if key not in best or best[key][0] < score:
                            best[key] = (score, q, n, a - int(w.first[r]))
        for (r, item_id), v in sorted(best.items()):
            yield r, item_id, *v


def _local(vocabulary: np.ndarray, indexes: list[Index]) -> list[np.ndarray]:
    """For each index the numbers of the block's words in its own vocabulary."""
    out = []
    for x in indexes:
        to = np.full(len(vocabulary) + 1, -1, np.int64)
        to[np.searchsorted(vocabulary, x.vocabulary)] = np.arange(len(x.vocabulary))
        out.append(to)
    return out


LEAK = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word of every leak.

    Null, empty and blank texts leak nothing, and such items match nothing;
    a repeated row gives its leaks again. first_word counts words of letters and digits from
    0, at the start of the window. Scores are rounded to six places. Extra columns are ignored."""
    d = docs.select(F.col("doc_id").cast("long"), "text")
    out = docs.sparkSession.createDataFrame([], LEAK)
    for indexes in index_blocks(benchmark):
        shared = _prepared(d, indexes)

        def run(batches, shared=shared):
            vocabulary, idx = shared.value
            look, local = Lookup(vocabulary), _local(vocabulary, idx)
            for b in batches:
                rows = list(_leaks(b.column("text"), look, idx, local, threshold))
                if rows:
                    r, item, score, q, a, first = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(r)), pa.array(item, pa.int64()), *(pa.array(np.round(c, 6)) for c in (score, q, a)), pa.array(first, pa.int64())],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
                    )

        out = out.union(d.mapInArrow(run, LEAK))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, its columns as they are, without the rows that leak an item by the rules of find_leaks().

    Rows with null, empty or blank texts stay; repeated rows stay or go together; empty tables of either kind change nothing."""
    for indexes in index_blocks(benchmark):
        shared = _prepared(docs.select("text"), indexes)

        def run(batches, shared=shared):
            vocabulary, idx = shared.value
            look, local = Lookup(vocabulary), _local(vocabulary, idx)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in _leaks(b.column("text"), look, idx, local, threshold)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
