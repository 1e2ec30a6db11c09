"""N-gram Jaccard join with PartEnum signatures.

Sets of hashed n-word shingles with |A & B| / |A | B| >= t differ in at most
(1 - t) / (1 + t) * (|A| + |B|) elements. Sets are put in bands by size; in a
band the hashed feature domain is cut into first-level partitions of three
second-level parts each, and the parts' 2-subsets are enumerated: a first-level
partition in which two sets differ by at most one element leaves two of its
three parts equal, so both sets share the signature of those two. Sets near
the upper end of a band also enter the next one, which holds their larger
partners.

Why no link is lost. Call a partition of a set good if at least two of its
parts hold elements, so that each of its signatures holds some. If a linked
pair shared no signature of a good partition, that partition would hold two
differences or more. A set is settled if, times two, its good partitions are
more than the differences that a linked partner can have: then all its
partners share a signature with it. A set that isn't settled in one cut of the
domain adds signatures of further cuts, and at last its single elements.

Why buckets stay small. The same argument holds for the good partitions of
which no signature fell in a large bucket. If they still settle a set, it can
leave its large buckets, as its partners were met in small ones. The sets that
can't (few: those whose texts are largely made of passages that many others
have) are bucketed again by single elements, with the same argument, and what
isn't settled there either is open. Open sets that share large buckets,
directly or not, are a cluster; two open sets that are linked are in one.

How clusters are counted. Jaccard distance is a metric. Every open set's distance
from one set of its cluster, the pivot, is taken, and sets are dealt to blocks by it.
Of two blocks, all pairs are linked if the largest distances add up to the limit
at most, none is if the distances or sizes are too far apart; else their sets are compared, by
exact intersections from a matrix product over the elements that both blocks have. Tight families of near
copies are so counted without comparing their pairs. What leaves a pair of
blocks is the number of links of each set and a spanning forest, never the pairs.

Other candidate pairs are thinned by size and by parity sketches, which differ in no
more places than the sets do in elements, and then verified on whole sets.
Identical sets are one node all along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.llm import textvec as tv
from veritrove.operators.cluster import components
from veritrove.plans.session import shuffle_partitions, written

MAX_CUTS = 3
SMALL_BUCKET = 16
SKETCH_BITS = 1024
#: Bytes of elements in a block of a cluster, about; classes of distance from the pivot; numbers in a product's slice.
BLOCK_BYTES, DISTANCES, SLICE_CELLS = 1 << 20, 64, 1 << 22
#: Classes of distance that need more than a block, at most: their sizes are broadcast. Beyond that, blocks grow.
MOST_LARGE = 1 << 16
#: Parts that a key with many rows is dealt out to.
SALTS = 64
REDUCER_SIGNATURES = 4_000_000  # signatures a reduce task gets on average, at most
MOST_BANDS = 34
#: A signature that so many of every SAMPLE-th document share is hot: its rows are members of a large bucket at once,
#: dealt out by set, and no task gathers them. At most HOT_MOST are broadcast. Results don't depend on these.
SAMPLE, HOT_COUNT, HOT_MOST = 64, 64, 1 << 16
_ODD = np.uint64(0xD6E8FEB86659FD93)


def set_hash(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit fingerprint of each text's distinct values: a sum of mixed elements and the size."""
    total = np.zeros(n, np.uint64)
    if len(values):
        starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        total[text[starts]] = np.add.reduceat(tv.mix(values * _ODD + np.uint64(7)), starts)
    sizes = np.bincount(text, minlength=n).astype(np.uint64)
    return tv.mix(total + sizes * np.uint64(0xA24BAED4963EE407))


def _sets(texts: pa.Array, n_words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, values, text index, sizes) of each slice."""
    for s in tv.slices(texts):
        w = tv.words(s)
        v, t = tv.distinct(*tv.shingles(w, tv.hashes(w), n_words))
        yield s.lo, len(s), v, t, np.bincount(t, minlength=len(s))


def _mapped(schema: pa.Schema, fn):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cols in fn(b):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def sketches(values: np.ndarray, text: np.ndarray, n: int) -> list[bytes]:
    """The parity of the elements that fall on each place, of as many places as elements
    or SKETCH_BITS, up to the next power of two."""
    out = []
    cut = np.searchsorted(text, np.arange(n + 1))
    mixed = tv.mix(values)
    for a, z in zip(cut.tolist(), cut[1:].tolist()):
        bits = max(SKETCH_BITS, 1 << max(0, z - a - 1).bit_length())
        place = (mixed[a:z] & np.uint64(bits - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes())
    return out


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch (last axis: bytes) of fewer places: the halves' parities add up."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def set_nodes(docs: DataFrame, n_words: int = 5) -> DataFrame:
    """doc_id, n_shingles, fp (null for an empty set), sketch of each row."""

    def fn(b):
        ids = b.column("doc_id")
        for lo, n, v, t, sizes in _sets(b.column("text"), n_words):
            fp = set_hash(v, t, n).view(np.int64)
            yield ids.slice(lo, n), sizes, pa.array(fp, mask=sizes == 0), pa.array(sketches(v, t, n), pa.binary())

    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.int64()), ("sketch", pa.binary())])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_mapped(schema, fn), "doc_id long, n_shingles long, fp long, sketch binary")


def band_of(sizes: np.ndarray) -> np.ndarray:
    """Bands hold sizes of [4**b, 4**(b+1))."""
    return ((np.frexp(np.maximum(sizes, 1).astype(float))[1] - 1) // 2).astype(np.int64)


def partitions_of(band: np.ndarray, threshold: float) -> np.ndarray:
    """First-level partitions in a band: a fifth more than half the largest difference between its sets."""
    widest = (1 - threshold) / (1 + threshold) * 2 * (4.0 ** (band + 1))
    return np.maximum(4, np.ceil(0.6 * 1.17 * widest)).astype(np.int64)


def most_differing(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Elements by which a linked partner can differ; it has 1 / threshold times the elements at most."""
    return np.floor((1 - threshold) / (1 + threshold) * sizes * (1 + 1 / threshold) + 1e-9).astype(np.int64)


def signatures(values: np.ndarray, text: np.ndarray, sizes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """For each band step: signature, text, place rows, and for each text its spare.

    values are distinct and ascending within ascending texts. place tells the
    partitions of a text apart; spare is the number of good ones that a settled
    text can do without (-1: settled in a later cut, or by single elements)."""
    allowed = most_differing(sizes, threshold)
    own = band_of(sizes)
    higher = np.floor(sizes / threshold + 1e-9)
    for step in (0, 1):
        band = own + step
        left = sizes > 0
        if step:
            left &= higher >= 4.0 ** (own + 1)
        spare = np.full(len(sizes), -1)
        for cut in range(MAX_CUTS + 1):
            if not left.any():
                break
            keep = left[text]
            v, t = values[keep], text[keep]
            if cut == MAX_CUTS:  # single elements
                yield tv.mix(v + (band[t].astype(np.uint64) + np.uint64(99)) * np.uint64(0x9FB21C651E98DF25)), t, np.zeros(len(t), np.int64), band, spare
                break
            n1 = partitions_of(band, threshold)[t].astype(np.uint64)
            h = tv.mix(v + np.uint64(0x632BE59BD9B4E019 * (cut + 1) % 2**64))
            part = ((h >> np.uint64(32)) * n1 >> np.uint64(32)).astype(np.int64)
            wide = int(n1.max()) + 1
            key = (t * wide + part) * 3 + (h % np.uint64(3)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, x = key[order], tv.mix(v[order] ^ _ODD)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            total = np.add.reduceat(x, first)
            key = key[first]
            group = np.flatnonzero(np.r_[True, key[1:] // 3 != key[:-1] // 3])
            number = np.repeat(np.arange(len(group)), np.diff(np.r_[group, len(key)]))
            parts = np.zeros((len(group), 3), np.uint64)
            parts[number, key % 3] = total
            filled = np.zeros((len(group), 3), bool)
            filled[number, key % 3] = True
            owner = key[group] // 3 // wide
            where = key[group] // 3 % wide
            salt = tv.mix((where.astype(np.uint64) << np.uint64(8)) + np.uint64(cut) + (band[owner].astype(np.uint64) << np.uint64(48)))
            for omit, (i, j) in enumerate(((1, 2), (0, 2), (0, 1))):
                some = filled[:, i] | filled[:, j]
                s = tv.mix(salt + np.uint64((omit + 1) * int(_ODD) % 2**64) + parts[:, i] * np.uint64(3) + parts[:, j] * np.uint64(5))
                yield s[some], owner[some], where[some] * MAX_CUTS + cut, band, spare
            good = np.bincount(owner[filled.sum(1) >= 2], minlength=len(sizes))
            settled = 2 * good > allowed
            if cut == 0:
                spare[:] = np.where(left & settled, (2 * good - allowed - 1) // 2, -1)
            left &= ~settled


def _flat(rows: list) -> tuple[np.ndarray, ...]:
    """sig, owner, band, spare, place of all rows."""
    return (
        np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.concatenate([r[3][r[1]] for r in rows]),
        np.concatenate([r[4][r[1]] for r in rows]), np.concatenate([r[2] for r in rows]),
    )


def _column(x: np.ndarray) -> bytes:
    """Whole numbers of at least 0, in as few bytes each as the largest needs, and that width before them."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(x.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def split_of(weights: dict[int, float], least: int) -> np.ndarray:
    """First reduce task and number of tasks of each band (2 rows), by the bands' signatures.

    A set's signatures of a band go to that band's tasks only, so what is sent about a set isn't sent to all."""
    each = max(1.0, min(REDUCER_SIGNATURES, sum(weights.values()) / max(1, least)))
    count = np.array([max(1, -(-int(weights.get(b, 0)) // int(each))) for b in range(MOST_BANDS)], np.int64)
    has = np.array([b in weights for b in range(MOST_BANDS)])
    return np.stack([np.where(has, np.cumsum(np.where(has, count, 0)) - count, 0), count])


def _blobs(fp: np.ndarray, sizes: np.ndarray, rows: list, split: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each reduce task one blob: fingerprint, size, band, spare and number of rows of its texts, and the rows' signatures and places.

    Rows of hot signatures go to tasks by fingerprint, with their own task's number beside them."""
    if not rows:
        return
    sig, owner, band, spare, place = _flat(rows)
    parts = int(split.sum(0).max())
    own = split[0][band] + (sig % split[1][band].astype(np.uint64)).astype(np.int64)
    is_hot = hot[np.minimum(np.searchsorted(hot, sig), len(hot) - 1)] == sig if len(hot) else np.zeros(len(sig), bool)
    for kind in (0, 1):
        chosen = np.flatnonzero(is_hot == bool(kind))
        pid = own[chosen] if not kind else (fp[owner[chosen]] % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((owner[chosen] * 64 + band[chosen], pid))
        chosen, pid = chosen[order], pid[order]
        who = owner[chosen] * 64 + band[chosen]
        new = np.flatnonzero(np.r_[True, (pid[1:] != pid[:-1]) | (who[1:] != who[:-1])]) if len(pid) else np.zeros(0, np.int64)
        one, count = chosen[new], np.diff(np.r_[new, len(pid)])
        edges = np.flatnonzero(np.r_[True, np.diff(pid[new]) != 0, True]) if len(new) else np.zeros(1, np.int64)
        pids, blobs = [], []
        for a, z in zip(edges.tolist(), edges[1:].tolist()):
            t, at = one[a:z], chosen[new[a] : new[z] if z < len(new) else len(pid)]
            body = [np.array([z - a, len(at), kind], "<u4").tobytes(), fp[owner[t]].tobytes(), (sig[at] >> np.uint64(32)).astype("<u4").tobytes()]
            body += [_column(c) for c in (sizes[owner[t]], band[t], spare[t] + 1, count[a:z], place[at])]
            if kind:
                body.append(_column(own[at]))
            blobs.append(b"".join(body))
            pids.append(int(pid[new[a]]))
        if pids:
            yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array(blobs, pa.binary())], names=["pid", "blob"])


def _unpacked(x: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text: fingerprint, size, band, spare, number of rows. Of each row: signature, place; and its own task's number if it is hot."""
    n, m, kind = (int(v) for v in np.frombuffer(x, "<u4", 3))
    fp, sig = np.frombuffer(x, "<u8", n, 12), np.frombuffer(x, "<u4", m, 12 + 8 * n)
    at, columns = 12 + 8 * n + 4 * m, []
    for length in (n, n, n, n, m, m)[: 6 if kind else 5]:
        columns.append(np.frombuffer(x, f"<u{x[at]}", length, at + 1))
        at += 1 + x[at] * length
    size, band, spare, count, place, *own = columns
    return [fp, size.astype(np.int64), band.astype(np.int64), spare.astype(np.int64) - 1, count.astype(np.int64)], [sig, place, *own]


def _fresh_signatures(b: pa.RecordBatch, n_words: int, threshold: float, seen: set[int]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """fp, sizes, rows of each slice's sets that the task hasn't met yet."""
    for _, n, v, t, sizes in _sets(b.column("text"), n_words):
        fp = set_hash(v, t, n)
        fresh = np.zeros(n, bool)
        for i, x in enumerate(fp.tolist()):
            if sizes[i] and x not in seen:
                seen.add(x)
                fresh[i] = True
        keep = fresh[t]
        yield fp, sizes, list(signatures(v[keep], t[keep], np.where(fresh, sizes, 0), threshold))


def _element_rows(b: pa.RecordBatch, threshold: float) -> tuple[np.ndarray, np.ndarray, list]:
    """fp, sizes, rows of (fp, band, elements), each element a signature."""
    fp = np.array(b.column("fp")).view(np.uint64)
    band = np.array(b.column("band")).astype(np.int64)
    values = [np.frombuffer(x, np.uint64) for x in b.column("elements").to_pylist()]
    sizes = np.array([len(x) for x in values], np.int64)
    if not len(fp):
        return fp, sizes, []
    t = np.repeat(np.arange(len(fp)), sizes)
    place = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    spare = np.maximum(sizes - most_differing(sizes, threshold) - 1, -1)
    sig = tv.mix(np.concatenate(values) + (band[t].astype(np.uint64) + np.uint64(7)) * np.uint64(0x9FB21C651E98DF25))
    return fp, sizes, [(sig, t, place, band, spare)]


def _hot(rows: DataFrame, each) -> np.ndarray:
    """Signatures that many of a sample's sets share, in order; each(batch, seen) gives fp, sizes, rows."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for fp, _, found in each(b, seen):
                for r in found:
                    yield pa.RecordBatch.from_arrays([pa.array(r[0].view(np.int64)), pa.array(fp[r[1]].view(np.int64))], names=["sig", "fp"])

    counts = rows.mapInArrow(run, "sig long, fp long").distinct().groupBy("sig").count().where(F.col("count") >= HOT_COUNT)
    return np.sort(np.array([r["sig"] for r in counts.orderBy(F.desc("count"), "sig").limit(HOT_MOST).collect()], np.int64).view(np.uint64))


def _dealt(blobs: DataFrame, split: np.ndarray) -> DataFrame:
    return blobs.repartitionById(int(split.sum(0).max()), F.col("pid"))


def _signature_blobs(docs: DataFrame, n_words: int, threshold: float, split: np.ndarray) -> DataFrame:
    """The blobs of whole texts. A task passes over sets that it has met."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    hot = _hot(sample, lambda b, seen: _fresh_signatures(b, n_words, threshold, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for fp, sizes, rows in _fresh_signatures(b, n_words, threshold, seen):
                yield from _blobs(fp, sizes, rows, split, hot)

    return _dealt(docs.select("text").mapInArrow(run, "pid int, blob binary"), split)


def _element_blobs(sets: DataFrame, threshold: float, split: np.ndarray) -> DataFrame:
    """The blobs of (fp, band, elements) rows."""
    sample = sets.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).select("fp", "band", "elements")
    hot = _hot(sample, lambda b, seen: [_element_rows(b, threshold)])

    def run(batches):
        for b in batches:
            yield from _blobs(*_element_rows(b, threshold), split, hot)

    return _dealt(sets.select("fp", "band", "elements").mapInArrow(run, "pid int, blob binary"), split)


def _members(key: np.ndarray, fp: np.ndarray, band: np.ndarray, spare: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    no = pa.nulls(len(key), pa.int64())
    rest = [pa.array(c.astype(np.int64)) for c in (band, spare, place)]
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)), no, *rest], names=FOUND)


def _buckets(threshold: float):
    """From a reduce task's blobs: candidate pairs (sig null) of small buckets; members of large ones (b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        met: set[int] = set()  # a set's hot rows come in one blob from each task that has a copy of it
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if np.frombuffer(x, "<u4", 3)[2]:
                    (fp, _, band, spare, count), (sig, place, own) = _unpacked(x)
                    fresh = np.array([v not in met for v in fp.tolist()], bool)
                    met.update(fp.tolist())
                    rows = np.repeat(fresh, count)
                    fp, band, spare = (np.repeat(c[fresh], count[fresh]) for c in (fp, band, spare))
                    yield _members((own[rows].astype(np.int64) << 32) + sig[rows].astype(np.int64), fp, band, spare, place[rows])
                else:
                    blobs.setdefault(p, []).append(x)
        for p in list(blobs):
            texts, rows = zip(*(_unpacked(x) for x in blobs.pop(p)))
            s = np.concatenate([r[0] for r in rows])
            order = np.argsort(s, kind="stable")
            same = s[order][1:] == s[order][:-1]
            order = order[np.r_[same, False] | np.r_[False, same]]  # what is alone in its bucket goes
            s = s[order]
            if not len(s):
                continue
            place = np.concatenate([r[1] for r in rows])[order]
            f, size, band, spare, count = (np.concatenate(c) for c in zip(*texts))
            text = np.repeat(np.arange(len(f), dtype=np.uint32), count)[order]
            del texts, rows, same, order
            f, size, band, spare = (c[text] for c in (f, size, band, spare))
            order = np.lexsort((f, s))
            s, f, size, band, spare, place = (c[order] for c in (s, f, size, band, spare, place))
            new = np.r_[True, (s[1:] != s[:-1]) | (f[1:] != f[:-1])]
            s, f, size, band, spare, place = (c[new] for c in (s, f, size, band, spare, place))
            start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            count = np.diff(np.r_[start, len(s)])
            pairs = []
            for k in range(2, SMALL_BUCKET + 1):
                at = start[count == k]
                if len(at):
                    i, j = np.triu_indices(k, 1)
                    i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                    near = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
                    pairs.append(np.stack([f[i][near], f[j][near]], 1))
            if pairs:
                pair = np.concatenate(pairs).view(np.int64)
                pair = np.unique(np.sort(pair, axis=1), axis=0)
                no = pa.nulls(len(pair), pa.int64())
                yield pa.RecordBatch.from_arrays([no, pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), no, no, no], names=FOUND)
            big = np.repeat(count > SMALL_BUCKET, count)
            if big.any():
                yield _members((np.int64(p) << 32) + s[big].astype(np.int64), f[big], band[big], spare[big], place[big])

    return run


FOUND = ["sig", "a", "b", "band", "spare", "place"]
FOUND_SCHEMA = ", ".join(f"{x} long" for x in FOUND)


def _unsettled(found: DataFrame) -> DataFrame:
    """fp, band of the members that need their large buckets."""
    lost = found.where("sig is not null").groupBy("a", "band").agg(F.countDistinct("place").alias("lost"), F.max("spare").alias("spare"))
    return lost.where("lost > spare").select(F.col("a").alias("fp"), "band")


def _elements(docs: DataFrame, groups: DataFrame, fps: DataFrame, n_words: int) -> DataFrame:
    """fp, elements (sorted uint64 bytes) of the wanted fingerprints, one row each."""
    rep = groups.join(fps, "fp").select("rep").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(rep, "rep", "left_semi").select("text")

    def fn(b):
        for _, n, v, t, sizes in _sets(b.column(0), n_words):
            fp = set_hash(v, t, n).view(np.int64)
            cut = np.searchsorted(t, np.arange(n + 1))
            yield fp, pa.array([v[cut[i] : cut[i + 1]].tobytes() for i in range(n)], pa.binary())

    schema = pa.schema([("fp", pa.int64()), ("elements", pa.binary())])
    return texts.mapInArrow(_mapped(schema, fn), "fp long, elements binary").dropDuplicates(["fp"])


def similar(one: bytes, other: bytes, threshold: float) -> bool:
    """|A & B| >= t * |A | B|, in whole numbers of hundredths of a percent."""
    x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
    t = round(threshold * 10_000)
    if min(len(x), len(y)) * 10_000 < t * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 10_000 * both >= t * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of fingerprints whose sets are similar."""
    one = sets.select(F.col("fp").alias("a"), F.col("elements").alias("one"))
    other = sets.select(F.col("fp").alias("b"), F.col("elements").alias("other"))

    def run(batches):
        for b in batches:
            ok = pa.array([similar(x.as_py(), y.as_py(), threshold) for x, y in zip(b.column("one"), b.column("other"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other").mapInArrow(run, "a long, b long")


def _close(differ: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, threshold: float) -> np.ndarray:
    most = (1 - threshold) / (1 + threshold) * (size_x + size_y)
    return (differ <= most + 1e-6) & (np.minimum(size_x, size_y) >= threshold * np.maximum(size_x, size_y) - 1e-9)


def _thinned(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sizes and sketches allow a link."""

    def run(batches):
        for b in batches:
            differ = np.empty(b.num_rows)
            for k, (x, y) in enumerate(zip(b.column("sx"), b.column("sy"))):
                x, y = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
                least = min(len(x), len(y))
                differ[k] = np.bitwise_count(folded(x, least) ^ folded(y, least)).sum()
            nx, ny = (np.array(b.column(c)) for c in ("nx", "ny"))
            ok = pa.array(_close(differ, nx, ny, threshold))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    x = known.select(F.col("fp").alias("a"), F.col("n_shingles").alias("nx"), F.col("sketch").alias("sx"))
    y = known.select(F.col("fp").alias("b"), F.col("n_shingles").alias("ny"), F.col("sketch").alias("sy"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "nx", "ny", "sx", "sy").mapInArrow(run, "a long, b long")


def _packed(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements of the rows' sets, and their rows."""
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in column]
    sizes = np.array([len(x) for x in sets], np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.repeat(np.arange(len(sets)), sizes)


def intersections(one: tuple[np.ndarray, np.ndarray], n: int, other: tuple[np.ndarray, np.ndarray], m: int) -> np.ndarray:
    """(n, m) numbers of common elements of two lists of sets, by matrix products over the elements that occur in both."""
    (v, i), (w, j) = one, other
    common = np.intersect1d(v, w)
    out = np.zeros((n, m), np.float32)
    keep, both = np.isin(v, common), np.isin(w, common)
    p, q = np.searchsorted(common, v[keep]), np.searchsorted(common, w[both])
    i, j = i[keep], j[both]
    step = max(256, SLICE_CELLS // max(1, n + m))
    for a in range(0, len(common), step):
        x, y = np.zeros((n, min(step, len(common) - a)), np.float32), np.zeros((m, min(step, len(common) - a)), np.float32)
        here, there = (p >= a) & (p < a + step), (q >= a) & (q < a + step)
        x[i[here], p[here] - a] = 1
        y[j[there], q[there] - a] = 1
        out += x @ y.T
    return out


def linked_matrix(both: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, threshold: float) -> np.ndarray:
    """|A & B| >= t * |A | B| for a matrix of intersections, in whole numbers of hundredths of a percent."""
    both = both.astype(np.int64)
    return 10_000 * both >= round(threshold * 10_000) * (size_x[:, None] + size_y[None] - both)


def spanning(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges, fewer than rows and columns, that join what a boolean matrix of links between a and b joins."""
    left, x, y = np.flatnonzero(links.any(1)), [], []
    open_rows = np.zeros(len(a), bool)
    open_rows[left] = True
    while open_rows.any():
        start = int(np.argmax(open_rows))
        rows, cols = np.zeros(len(a), bool), np.zeros(len(b), bool)
        now = np.zeros(len(a), bool)
        now[start] = True
        while now.any():
            rows |= now
            new = links[now].any(0) & ~cols
            cols |= new
            now = links[:, new].any(1) & ~rows
        open_rows &= ~rows
        for ids in (a[rows], b[cols]):
            x.append(np.full(len(ids), a[start]))
            y.append(ids)
    if not x:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(x), np.concatenate(y)


def _blocks(cluster: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """cluster, a, elements, size, d (distance from the pivot, the cluster's smallest node), near (linked with it), bin, block."""
    m = cluster.join(sets.select(F.col("fp").alias("a"), "elements"), "a").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    pivot = sets.select(F.col("fp").alias("cluster"), F.col("elements").alias("pivot")).join(cluster.select("cluster").distinct(), "cluster")
    pivot = pivot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))

    def run(batches):
        for b in batches:
            d, near = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column("elements"), b.column("pivot"))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                d[k] = 1 - both / (len(x) + len(y) - both)
                near[k] = 10_000 * both >= round(threshold * 10_000) * (len(x) + len(y) - both)
            bins = np.minimum((d * DISTANCES).astype(np.int64), DISTANCES - 1)
            yield pa.RecordBatch.from_arrays([b.column("cluster"), b.column("a"), b.column("elements"), pa.array(d), pa.array(near), pa.array(bins)], names=["cluster", "a", "elements", "d", "near", "bin"])

    m = m.join(pivot, ["cluster", "salt"]).select("cluster", "a", "elements", "pivot")
    m = m.mapInArrow(run, "cluster long, a long, elements binary, d double, near boolean, bin long")
    m = written(m.withColumn("size", F.expr("octet_length(elements) div 8")), "open-sets")
    total = m.agg(F.sum("size")).first()[0] or 0
    limit = max(BLOCK_BYTES // 8, total // MOST_LARGE)
    # classes of over `limit` elements are no more than MOST_LARGE, so their sizes may be broadcast
    large = m.groupBy("cluster", "bin").agg(F.sum("size").alias("n")).where(F.col("n") > limit)
    large = large.select("cluster", "bin", F.ceil(F.col("n") / limit).cast("long").alias("blocks"))
    return m.join(F.broadcast(large), ["cluster", "bin"], "left").withColumn("block", F.pmod(F.xxhash64("a"), F.coalesce("blocks", F.lit(1)))).drop("blocks")


def _counted(cluster: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, n: links of each open set within its cluster), (a, b: edges that join what is linked there)."""
    m = _blocks(cluster, sets, threshold)
    key = ["cluster", "bin", "block"]
    stats = written(m.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.min("size").alias("small"), F.max("size").alias("big")
    ), "blocks")
    names = ["bin", "block", "n", "lo", "hi", "small", "big"]
    x = stats.select("cluster", *(F.col(c).alias(f"x_{c}") for c in names))
    y = stats.select("cluster", *(F.col(c).alias(f"y_{c}") for c in names))
    most = 1 - threshold
    p = x.join(y, "cluster").where("x_bin < y_bin or (x_bin = y_bin and x_block <= y_block)")
    p = p.where((F.col("y_lo") - F.col("x_hi") <= most + 1e-9) & (F.col("x_lo") - F.col("y_hi") <= most + 1e-9))
    p = p.where((F.col("x_big") >= threshold * F.col("y_small") - 1e-9) & (F.col("y_big") >= threshold * F.col("x_small") - 1e-9))
    p = p.withColumn("own", F.expr("x_bin = y_bin and x_block = y_block")).withColumn("sure", F.col("x_hi") + F.col("y_hi") <= most - 1e-9)
    p = written(p, "block-pairs")
    sure = p.where("sure")
    whole = sure.select("cluster", F.col("x_bin").alias("bin"), F.col("x_block").alias("block"), F.expr("if(own, y_n - 1, y_n)").alias("n"))
    whole = whole.union(sure.where("not own").select("cluster", "y_bin", "y_block", "x_n")).groupBy(*key).agg(F.sum("n").alias("n"))
    counts = m.join(whole, key).select("a", "n")

    pair = F.xxhash64("x_bin", "x_block", "y_bin", "y_block").alias("pair")
    todo = p.where("not sure")
    sides = todo.select("cluster", F.col("x_bin").alias("bin"), F.col("x_block").alias("block"), pair, F.lit(0).alias("side"))
    sides = sides.union(todo.where("not own").select("cluster", "y_bin", "y_block", pair, F.lit(1)))
    rows = m.join(sides, key).select("cluster", "pair", "side", "a", "elements")

    def run(key, table):
        side, a = np.array(table.column("side")), np.array(table.column("a"))
        i, j = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        own = not len(j)
        elements = table.column("elements").combine_chunks()
        one = _packed(elements.take(pa.array(i)))
        other = one if own else _packed(elements.take(pa.array(j)))
        j = i if own else j
        links = linked_matrix(intersections(one, len(i), other, len(j)), np.bincount(one[1], minlength=len(i)), np.bincount(other[1], minlength=len(j)), threshold)
        if own:
            np.fill_diagonal(links, False)
        src, dst = spanning(links, a[i], a[j])
        ids, n = (a[i], links.sum(1)) if own else (np.concatenate([a[i], a[j]]), np.concatenate([links.sum(1), links.sum(0)]))
        some = n > 0
        return pa.table({
            "a": np.concatenate([ids[some], src]), "b": pa.array(np.concatenate([np.zeros(int(some.sum()), np.int64), dst]), mask=np.arange(int(some.sum()) + len(src)) < int(some.sum())),
            "n": np.concatenate([n[some].astype(np.int64), np.zeros(len(src), np.int64)]),
        })

    compared = written(rows.groupBy("cluster", "pair").applyInArrow(run, "a long, b long, n long"), "compared")
    near = m.where("near and a <> cluster").select(F.col("cluster").alias("a"), F.col("a").alias("b"))
    edges = compared.where("b is not null and a <> b").select("a", "b").union(near)
    return counts.union(compared.where("b is null").select("a", "n")), edges


def _linked(pairs: DataFrame, known: DataFrame, groups: DataFrame, n_words: int, threshold: float) -> DataFrame:
    """The linked ones of candidate pairs (a, b) of fingerprints, as a written table."""
    pairs = written(_thinned(pairs, groups, threshold), "pairs")
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    sets = written(_elements(known, groups, wanted, n_words), "sets")
    return written(_verified(pairs, sets, threshold), "links")


def _clusters(found: DataFrame, open_sets: DataFrame) -> DataFrame:
    """a, cluster (its smallest fingerprint) of the open sets that share large buckets, directly or not."""
    large = found.where("sig is not null").select("sig", F.col("a").alias("fp"), "band")
    members = large.join(open_sets, ["fp", "band"], "left_semi").select("sig", F.col("fp").alias("a")).distinct()
    # in two steps, so that no bucket is a hot key: the least of each part of a bucket, and of these the least
    members = members.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    parts = members.groupBy("sig", "salt").agg(F.min("a").alias("least"))
    near = members.join(parts, ["sig", "salt"]).where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    tops = parts.groupBy("sig").agg(F.min("least").alias("top"))
    far = parts.join(tops, "sig").where("least <> top").select(F.col("top").alias("a"), F.col("least").alias("b"))
    star = written(near.union(far).distinct(), "star")
    return written(components(star, "a", "b").select(F.col("node").alias("a"), F.col("component").alias("cluster")), "clusters")


def _weights(groups: DataFrame, threshold: float) -> dict[int, float]:
    """About how many signatures the sets have in each band; they are in their own, and near its upper end in the next one too."""
    size = F.col("n_shingles")
    own = F.floor(F.log(size.cast("double")) / F.log(F.lit(4.0)) + 1e-9).cast("int")
    bands = groups.select(size, own.alias("own")).withColumn("next", size >= threshold * F.pow(F.lit(4.0), F.col("own") + 1))
    sums = bands.groupBy("own").agg(F.sum(size * 1.25).alias("n"), F.sum(F.when(F.col("next"), size * 2.0)).alias("above")).collect()  # a row for each band
    out: dict[int, float] = {}
    for r in sums:
        out[r.own] = out.get(r.own, 0) + r.n
        if r.above:
            out[r.own + 1] = out.get(r.own + 1, 0) + r.above
    return out


def jaccard_components(docs: DataFrame, n_words: int = 5, threshold: float = 0.75) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links, the row's own
    included; n_links is the number of other distinct sets that the row's set is linked
    with. Both are exact (elements are 64-bit hashes).
    Empty, blank and null texts have n_shingles 0, no links and are their own component. A row with a
    null doc_id gets a null component and links nothing. Repeated rows come
    back as often as they went in; extra columns are ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    nodes = written(set_nodes(docs, n_words), "nodes")
    named = nodes.where("fp is not null and doc_id is not null")
    groups = named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    groups = written(groups, "groups")
    split = split_of(_weights(groups, threshold), shuffle_partitions(spark))
    known = docs.where("doc_id is not null")

    blobs = _signature_blobs(known, n_words, threshold, split)
    found = written(blobs.mapInArrow(_buckets(threshold), FOUND_SCHEMA), "buckets")
    pairs = found.where("sig is null").select("a", "b")
    open_sets = written(_unsettled(found), "unsettled")
    counts = edges = None
    if not open_sets.isEmpty():
        texts = written(_elements(known, groups, open_sets.select("fp").distinct(), n_words).join(open_sets, "fp"), "unsettled-sets")
        again = _element_blobs(texts, threshold, split).mapInArrow(_buckets(threshold), FOUND_SCHEMA)
        again = written(again, "elements")
        pairs = pairs.union(again.where("sig is null").select("a", "b"))
        open_sets = written(_unsettled(again), "open")
        cluster = None if open_sets.isEmpty() else _clusters(found, open_sets)
        if cluster is not None and not cluster.isEmpty():
            counts, edges = _counted(cluster, texts.select("fp", "elements").dropDuplicates(["fp"]), threshold)
            # pairs within a cluster are counted there
            one, other = cluster.select("a", F.col("cluster").alias("ca")), cluster.select(F.col("a").alias("b"), F.col("cluster").alias("cb"))
            pairs = pairs.join(one, "a", "left").join(other, "b", "left").where("ca is null or cb is null or ca <> cb").select("a", "b")
    links = _linked(pairs.distinct(), known, groups, n_words, threshold)
    ends = links.select("a", F.lit(1).cast("long").alias("n")).union(links.select("b", F.lit(1).cast("long")))
    if counts is not None:
        ends, links = ends.union(counts), links.union(edges)
    degree = ends.groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("n_links"))
    rep = groups.select("fp", "rep")
    joined = (
        links.join(rep.select(F.col("fp").alias("a"), F.col("rep").alias("src")), "a")
        .join(rep.select(F.col("fp").alias("b"), F.col("rep").alias("dst")), "b")
        .select("src", "dst")
    )
    comp = components(written(joined, "linked")).select(F.col("node").alias("rep"), "component")
    classes = written(rep.join(comp, "rep", "left").join(degree, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    return nodes.join(classes, "fp", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("fp").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, n_words: int = 5, threshold: float = 0.75) -> DataFrame:
    """docs, its columns as they are, with one document of each component: that with the smallest doc_id.

    Repeated rows with that id stay as they are; rows without text, words or doc_id stay; an empty table stays empty."""
    c = jaccard_components(docs, n_words, threshold).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(c, "doc_id", "left_anti")
