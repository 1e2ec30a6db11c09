"""Scoring texts with a log-bilinear language model trained in numpy by noise-contrastive estimation.

Words are counted over all training documents. Symbols are the end of a text,
all words of MIN_COUNT occurrences (the MOST_WORDS most frequent at most, which
is what a worker holds), and TAILS symbols for other words, told apart by their
last bytes; symbols are outputs, and contexts are the two symbols before. The
score of an output is bilinear, (A[c1] + B[c2]) . R[w], with a bias. Outputs are in classes: the
SINGLES most frequent and the tails are alone, the others go by their words' last bytes and frequency, so
log P(w) = log P(class | context) + log P(w | class, context), both from the
same context vector, and both normalised exactly by batched matrix products. Words
further down than BAND are too rare for vectors as outputs: in their classes they have their unigram shares.

Training goes over all training documents in batches on the workers, with sampled noise:
classes from their unigram distribution, and words from that of the
target's class. Each of ROUNDS rounds takes its share of the documents, starts every task from the
same parameters and merges what tasks have changed by rows, weighted by how often a
task has used a row. A word without a symbol of its own gets its tail symbol's
probability times its add-one share of the tail's words.

What a worker holds is bounded: the TOP most frequent words' counts and the
model. Counts of rarer words are joined by shuffling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.llm import textvec as tv
from veritrove.plans.session import written

#: The words up to BAND have vectors as outputs; those further down are in classes apart, where they keep their shares.
MIN_COUNT, MOST_WORDS, SINGLES, TAILS, BAND = 3, 1 << 15, 64, 64, 1 << 13
DIMENSIONS = 16
CLASS_NOISE, WORD_NOISE = 32, 2  # noise samples: classes for a batch, words for each word seen
RATE = 0.1
#: Words in a batch: few at first, then more; words that a task trains on at least where there are so many; rounds.
FIRST_BATCH, BATCH, TASK_WORDS, ROUNDS = 64, 8192, 1 << 24, 2
#: Training documents are passed over until so many words were seen, PASSES times at most and once at least.
SEEN_WORDS, PASSES = 2_000_000, 8
#: Rows of parameters that are merged at a time; numbers in a slice of a matrix product.
ROW_BLOCK, CELLS = 2048, 1 << 17
TOP = 1 << 19
FOLDS, HELD_OUT = 7, 2
END = np.uint64(0x7F4A7C159E3779B9)


def held_out() -> F.Column:
    """crc32 of the doc_id as text, modulo 7, is 2; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def tokens(s: tv.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of all texts, each text closed by END: hashes, tails (of the last three bytes), and the first place of each text (one more at the end)."""
    w = tv.words(s)
    h = tv.hashes(w)
    first = w.first + np.arange(len(w.first))
    place = np.arange(len(h)) + np.repeat(np.arange(len(s)), w.counts)
    out = np.full(len(h) + len(s), END)
    out[place] = h
    code = np.zeros(len(h), np.uint64)
    for k in range(1, 4):
        at = w.end - k
        code = code * np.uint64(256) + np.where(at >= w.start, w.data[np.maximum(at, 0)] if len(w.data) else 0, 0).astype(np.uint64)
    tail = np.zeros(len(out), np.int64)
    tail[place] = (tv.mix(code + np.uint64(1)) % np.uint64(TAILS)).astype(np.int64)
    return out, tail, first


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash), tail, n over all texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def summed():
            h, tail, n = (np.concatenate(x) for x in zip(*held))
            kinds, one, index = np.unique(h, return_index=True, return_inverse=True)
            return kinds, tail[one], np.bincount(index, n).astype(np.int64)

        def batch(kinds, tail, n):
            return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(tail.astype(np.int32)), pa.array(n)], names=["word", "tail", "n"])

        for b in batches:
            for s in tv.slices(b.column(0)):
                h, tail, _ = tokens(s)
                kinds, one, n = np.unique(h, return_index=True, return_counts=True)
                held.append((kinds, tail[one], n))
                size += len(kinds)
                if size > 1_000_000:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > 500_000:
                        yield batch(*held[0])
                        held, size = [], 0
        if held:
            yield batch(*summed())

    found = docs.select("text").mapInArrow(run, "word long, tail int, n long")
    return found.groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words: hashes in order, counts, symbols (-1 for none); totals of the corpus; counts of symbols; and shares of tails.

    Symbols are numbered by class, so a class is a range of them."""

    words: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    tail_symbols: np.ndarray  # of each tail
    rest: np.ndarray  # log10 of the add-one total of each tail's words without a symbol
    weights: np.ndarray  # of each symbol, for noise and as a start
    starts: np.ndarray  # first symbol of each class, and one past the last
    vectored: np.ndarray  # classes whose words have vectors
    total: int  # N
    kinds: int  # V
    modelled: int  # tokens that have symbols of their own

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash (0 where it isn't there), and whether it is."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        ok = self.words[at] == h
        return np.where(ok, at, 0), ok


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the table of counts; at most TOP rows and one for each tail come to the driver."""
    tails = {r["tail"]: (r["n"], r["kinds"]) for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    total, kinds = sum(n for n, _ in tails.values()), sum(k for _, k in tails.values())
    most = 1 << 16
    steps = counts.groupBy(F.least("n", F.lit(most)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()
    least, have = most + 1, 0
    for r in steps:
        if have + r["words"] > TOP:
            break
        have += r["words"]
        least = r["n"]
    top = counts.where(F.col("n") >= least) if have else counts.orderBy(F.desc("n"), "word").limit(TOP)
    got = top.toArrow()
    words, tail, n = np.array(got.column("word")).view(np.uint64), np.array(got.column("tail"), np.int64), np.array(got.column("n"))
    if END not in words:
        words, tail, n = np.r_[words, END], np.r_[tail, 0], np.r_[n, 0]
    order = np.argsort(words)
    words, tail, n = words[order], tail[order], n[order]
    ranked = np.array([k for k in np.lexsort((words, -n)) if words[k] != END and n[k] >= MIN_COUNT][:MOST_WORDS], np.int64)
    alone, more = ranked[: SINGLES - 1], ranked[SINGLES - 1 :]
    symbols = np.full(len(words), -1, np.int32)
    end = int(np.searchsorted(words, END))
    symbols[end] = 0
    symbols[alone] = 1 + np.arange(len(alone))
    tail_symbols = 1 + len(alone) + np.arange(TAILS)
    key = tail[more] * 2 + (np.arange(len(more)) >= BAND)
    order = np.argsort(key, kind="stable")
    more, key = more[order], key[order]
    wide = 1 + len(alone) + TAILS  # symbols alone in their classes
    symbols[more] = wide + np.arange(len(more))
    starts = np.r_[np.arange(wide), wide + np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[: len(more)], wide + len(more)]
    vectored = np.zeros(len(starts) - 1, bool)
    vectored[wide:] = key[starts[wide:-1] - wide] % 2 == 0
    own = np.flatnonzero(symbols >= 0)
    left_n, left_kinds = np.zeros(TAILS), np.zeros(TAILS)
    for t, (a, k) in tails.items():
        left_n[t], left_kinds[t] = a, k
    left_n -= np.bincount(tail[own], n[own], minlength=TAILS)
    left_kinds -= np.bincount(tail[own], (n[own] > 0).astype(float), minlength=TAILS)
    weights = np.zeros(wide + len(more))
    weights[symbols[own]] = n[own] + 1.0
    weights[tail_symbols] = left_n + 1
    return Vocabulary(
        words, n, symbols, tail_symbols, np.log10(left_n + left_kinds + 1), weights, starts, vectored, int(total), int(kinds), int(n[own].sum())
    )


def _symbols(s: tv.Slice, v: Vocabulary) -> tuple[np.ndarray, ...]:
    """Hashes, tails, first places, places in v, known, symbols of the tokens, and both contexts' symbols (end before a text's start)."""
    h, tail, first = tokens(s)
    at, ok = v.look(h)
    own = v.symbols[at]
    w = np.where(ok & (own >= 0), own, v.tail_symbols[tail]).astype(np.int64)
    c1, c2 = np.r_[0, w[:-1]], np.r_[0, 0, w[:-2]][: len(w)]
    if len(w):
        c1[first[:-1]] = 0
        c2[first[:-1]] = 0
        second = first[:-1] + 1
        c2[second[second < len(w)]] = 0
    return h, tail, first, at, ok, w, c1, c2


def _summed(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of their gradients, and how many they are."""
    order = np.argsort(rows.astype(np.int32))
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return rows[first], np.add.reduceat(grads[order], first, axis=0), np.diff(np.r_[first, len(rows)])


class LogBilinear:
    """score(class) = (A[c1] + B[c2]) . C[class]; score(w in its class) = (A[c1] + B[c2]) . R[w]; the last dimension holds the biases."""

    def __init__(self, weights: np.ndarray, starts: np.ndarray, vectored: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        n, k = len(weights), len(starts) - 1
        self.starts, self.vectored = starts, vectored
        self.of = np.repeat(np.arange(k), np.diff(starts))  # class of each symbol
        mass = np.add.reduceat(weights, starts[:-1])
        self.log_class = np.log(mass / mass.sum()).astype(np.float32)
        self.log_word = np.log(weights / mass[self.of]).astype(np.float32)  # within the class
        self.cum = np.cumsum(weights / weights.sum())
        # the last dimension of a context is always one, so that of an output is its bias
        self.p = {x: rng.normal(0, 0.1, (n, DIMENSIONS)).astype(np.float32) for x in "AB"}
        self.p["A"][:, -1], self.p["B"][:, -1] = 1, 0
        self.p |= {"R": np.zeros((n, DIMENSIONS), np.float32), "C": np.zeros((k, DIMENSIONS), np.float32)}
        self.p["R"][:, -1], self.p["C"][:, -1] = self.log_word, self.log_class

    def begin(self) -> None:
        """Before training: the rates are as at the start."""
        self.squares = {k: np.zeros(len(v), np.float32) for k, v in self.p.items()}
        self.used = {k: np.zeros(len(v), np.float32) for k, v in self.p.items()}

    def _step(self, name: str, rows: np.ndarray, grads: np.ndarray) -> None:
        """Adagrad with one rate a row."""
        rows, g, n = _summed(rows, grads)
        self.used[name][rows] += n
        squares = self.squares[name][rows] + np.einsum("nd,nd->n", g, g) / g.shape[1]
        self.squares[name][rows] = squares
        g *= (RATE / np.sqrt(squares + 1e-8))[:, None]
        self.p[name][rows] -= g

    def train(self, w: np.ndarray, c1: np.ndarray, c2: np.ndarray, rng: np.random.Generator) -> None:
        """One step of noise-contrastive estimation on a batch."""
        p = self.p
        h = p["A"][c1] + p["B"][c2]
        k = self.of[w]
        ends = self.cum[self.starts[1:] - 1]
        noise = np.minimum(np.searchsorted(ends, rng.random(CLASS_NOISE) * ends[-1], "right"), len(ends) - 1)
        own, others = p["C"][k], p["C"][noise]
        yes = _sigmoid(np.einsum("nd,nd->n", h, own) - self.log_class[k] - np.float32(np.log(CLASS_NOISE))) - 1
        no = _sigmoid(h @ others.T - self.log_class[noise] - np.float32(np.log(CLASS_NOISE)))
        g_h = yes[:, None] * own + no @ others
        g_c, rows = np.concatenate([yes[:, None] * h, no.T @ h]), np.concatenate([k, noise])
        wide = np.flatnonzero(self.vectored[k])
        if len(wide):
            hw, kw = h[wide], k[wide]
            first, end = self.starts[kw], ends[kw]
            low = np.where(first > 0, self.cum[first - 1], 0)
            u = low[:, None] + rng.random((len(wide), WORD_NOISE)) * (end - low)[:, None]
            z = np.clip(np.searchsorted(self.cum, u, "right"), first[:, None], self.starts[kw + 1][:, None] - 1)
            both = np.concatenate([w[wide, None], z], 1)
            vec = p["R"][both]
            g = _sigmoid(np.einsum("nd,nkd->nk", hw, vec) - self.log_word[both] - np.float32(np.log(WORD_NOISE)))
            g[:, 0] -= 1
            g_h[wide] += np.einsum("nk,nkd->nd", g, vec)
            self._step("R", both.ravel(), (g[:, :, None] * hw[:, None]).reshape(-1, DIMENSIONS))
        g_h[:, -1] = 0
        self._step("C", rows, g_c)
        self._step("A", c1, g_h)
        self._step("B", c2, g_h)

    def log10(self, w: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        """log10 P(w | c2, c1), normalised over all symbols: products with all classes, then with all words of each token's class."""
        p = self.p
        out = np.empty(len(w), np.float32)
        k = self.of[w]
        step = max(1, CELLS // max(1, len(self.starts) - 1))
        h = p["A"][c1] + p["B"][c2]
        bounded = _longest(h) * max(_longest(p["C"]), _longest(p["R"])) < 60
        for a in range(0, len(w), step):
            out[a : a + step] = _log_share(h[a : a + step] @ p["C"].T, k[a : a + step], bounded)
        plain = np.flatnonzero(~self.vectored[k])
        out[plain] += self.log_word[w[plain]]
        order = np.argsort(k, kind="stable")
        edge = np.searchsorted(k[order], np.arange(len(self.starts)))
        for c in np.flatnonzero((np.diff(edge) > 0) & self.vectored).tolist():
            lo, hi = int(self.starts[c]), int(self.starts[c + 1])
            step = max(1, CELLS // (hi - lo))
            for a in range(int(edge[c]), int(edge[c + 1]), step):
                at = order[a : min(a + step, int(edge[c + 1]))]
                out[at] += _log_share(h[at] @ p["R"][lo:hi].T, w[at] - lo, bounded)
        return out / np.float32(np.log(10))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -30, 30)))


def _log_share(s: np.ndarray, at: np.ndarray, bounded: bool) -> np.ndarray:
    """log of the softmax of each row at a place; bounded: no exp() can overflow."""
    if not bounded:
        s -= s.max(1, keepdims=True)
    one = s[np.arange(len(s)), at]
    np.exp(s, out=s)
    return one - np.log(s.sum(1))


def _longest(x: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("nd,nd->n", x, x).max(initial=0)))


def _fitted(model: LogBilinear, texts: Iterator[pa.Array], v: Vocabulary, passes: int, seed: int) -> None:
    """Trains on a task's texts. A slice's words are taken in a random order, and again for each pass."""
    rng = np.random.default_rng(seed)
    model.begin()
    seen = 0
    for column in texts:
        for s in tv.slices(column):
            *_, w, c1, c2 = _symbols(s, v)
            for _ in range(passes):
                order = rng.permutation(len(w))
                a = 0
                while a < len(order):
                    size = min(BATCH, FIRST_BATCH + seen // 64)
                    at = order[a : a + size]
                    model.train(w[at], c1[at], c2[at], rng)
                    seen += len(at)
                    a += size


def train_model(train: DataFrame, v: Vocabulary) -> LogBilinear:
    """A model of all texts of train (doc_id, text): every document is in one of the rounds."""
    spark = train.sparkSession
    model = LogBilinear(v.weights, v.starts, v.vectored)
    if not v.total:
        return model
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-v.total // (TASK_WORDS >> 6))), v.total // TASK_WORDS)
    passes = int(min(PASSES, max(1, SEEN_WORDS // v.total)))
    vocabulary_ = spark.sparkContext.broadcast(v)
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, k=k, shared=shared):
            mine = LogBilinear.__new__(LogBilinear)
            mine.__dict__ = shared.value.__dict__ | {"p": {x: y.copy() for x, y in shared.value.p.items()}}
            _fitted(mine, (b.column(0) for b in batches), vocabulary_.value, passes, TaskContext.get().partitionId() * ROUNDS + k)
            for number, (x, new) in enumerate(sorted(mine.p.items())):
                rows = np.flatnonzero(mine.used[x])
                for a in np.unique(rows // ROW_BLOCK).tolist():
                    at = rows[rows // ROW_BLOCK == a]
                    change = (new[at] - shared.value.p[x][at]).astype(np.float16)
                    blob = at.astype("<i4").tobytes() + mine.used[x][at].astype("<f4").tobytes() + change.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([a], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([blob], pa.binary())], names=["kind", "part", "n", "blob"])

        part = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k).select("text").coalesce(tasks)
        found = part.mapInArrow(run, "kind int, part int, n int, blob binary")

        def merged(batches):
            total: dict[tuple[int, int], list[np.ndarray]] = {}
            for b in batches:
                for kind, a, n, blob in zip(*(b.column(c).to_pylist() for c in range(3)), b.column(3)):
                    raw = blob.as_py()
                    rows, used = np.frombuffer(raw, "<i4", n), np.frombuffer(raw, "<f4", n, 4 * n)
                    change = np.frombuffer(raw, "<f2", -1, 8 * n).astype(np.float32).reshape(n, -1)
                    if (kind, a) not in total:
                        total[kind, a] = [np.zeros(ROW_BLOCK, np.float32), np.zeros((ROW_BLOCK, change.shape[1]), np.float32)]
                    weight, rows_sum = total[kind, a]
                    at = rows - a * ROW_BLOCK
                    weight[at] += used
                    rows_sum[at] += change * used[:, None]
            for (kind, a), (weight, rows_sum) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([a], pa.int32()), pa.array([(rows_sum / np.maximum(weight, 1e-9)[:, None]).tobytes()], pa.binary())], names=["kind", "part", "blob"])

        rows = found.repartition("kind", "part").mapInArrow(merged, "kind int, part int, blob binary").collect()  # as large as the model
        names = sorted(model.p)
        for r in rows:
            table = model.p[names[r["kind"]]]
            a = r["part"] * ROW_BLOCK
            n = min(ROW_BLOCK, len(table) - a)
            table[a : a + n] += np.frombuffer(r["blob"], np.float32).reshape(ROW_BLOCK, -1)[:n]
    return model


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    base_score is the add-one unigram's log10 probability, score the model's.
    Null texts count as empty: one token, the end. With no training document
    every text is scored by an untrained model. Repeated rows are scored
    each; texts may be of any length. Words are told apart by 64-bit hashes. Extra columns are ignored."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out"))
    train = d.where("not held_out")
    counts = written(count_words(train), "counts")
    v = vocabulary(counts)
    model = train_model(train, v)
    shared = spark.sparkContext.broadcast((v, model))

    names = ["doc_id", "held_out", "n_tokens", "known", "logs", "model", "rare"]

    def run(batches):
        v, model = shared.value
        logs = np.log10(v.counts + 1.0)
        for b in batches:
            for s in tv.slices(b.column("text")):
                h, tail, first, at, ok, w, c1, c2 = _symbols(s, v)
                edge = first[:-1]
                log = np.where(ok, logs[at], 0.0)
                lp = model.log10(w, c1, c2).astype(np.float64)
                other = w == v.tail_symbols[tail]  # the end has tail 0, but its own symbol
                lp[other] += log[other] - v.rest[tail[other]]
                rare = np.flatnonzero(~ok)
                text = np.searchsorted(first, rare, "right") - 1
                key, times = np.unique(np.stack([text.astype(np.uint64), h[rare]], 1), axis=0, return_counts=True) if len(rare) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
                offsets = np.searchsorted(key[:, 0], np.arange(len(s) + 1, dtype=np.uint64)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(key[:, 1].copy().view(np.int64)), pa.array(times.astype(np.int32))], names=["word", "times"])
                add = lambda x, edge=edge: pa.array(np.add.reduceat(x, edge))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(s.lo, len(s)), b.column("held_out").slice(s.lo, len(s)), pa.array(np.diff(first)),
                        add((ok & (v.counts[at] > 0)).astype(np.int64)), add(log), add(lp), pa.ListArray.from_arrays(pa.array(offsets), pairs),
                    ],
                    names=names,
                )

    schema = "doc_id long, held_out boolean, n_tokens long, known long, logs double, model double, rare array<struct<word:long,times:int>>"
    thin = written(d.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "scores")
    rare = thin.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.times")
    found = rare.join(counts.select("word", "n"), "word").groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").cast("long").alias("more_known")
    )
    more = F.coalesce("more", F.lit(0.0))
    out = thin.drop("rare").join(found, "rid", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(float(np.log10(v.total + v.kinds + 1)))).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
