"""Conflict-constrained best-fit packing of documents into token sequences.

Documents longer than a bin are cut into full bins and a rest; nothing is
dropped. Pieces are packed by decreasing length. Bins are kept in order of
what room they have left and carry bitmaps of their sources and duplicate
clusters; for each piece the search begins at the first bin with enough room
and goes on to its successors until the tightest compatible one is found.

A bin takes no two documents of one duplicate cluster and no more than
`per_source` pieces of one source. Shards of bounded size are packed side by
side, so no task sees an unbounded group.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.llm import textvec as tv
from veritrove.plans.session import shuffle_partitions

CAPACITY = 2048
PER_SOURCE = 4
SHARD_ROWS = 2048


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, place in it) of each piece, all of 0 < length <= capacity (pieces of length 0 take no room).

    Bits stand for a shard's own sources and clusters, so bitmaps are exact.
    Compatible bins are tried from the tightest on; ties go to the older bin."""
    source_bit = {s: k for k, s in enumerate(dict.fromkeys(sources))}
    cluster_bit = {c: k for k, c in enumerate(dict.fromkeys(clusters))}
    room: list[tuple[int, int]] = []  # (room left, bin), in order
    full_sources: list[int] = []  # per bin: bitmap of the sources that it has per_source pieces of
    held: list[dict[int, int]] = []
    cluster_map: list[int] = []
    filled: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        s, c = source_bit[sources[k]], cluster_bit[clusters[k]]
        at = bisect_left(room, (lengths[k], -1))
        while at < len(room):
            b = room[at][1]
            if not (full_sources[b] >> s & 1 or cluster_map[b] >> c & 1):
                break
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(filled)
            full_sources.append(0)
            cluster_map.append(0)
            held.append({})
            filled.append(0)
        held[b][s] = held[b].get(s, 0) + 1
        if held[b][s] >= per_source:
            full_sources[b] |= 1 << s
        cluster_map[b] |= 1 << c
        out[k] = (b, filled[b])
        filled[b] += 1
        left -= lengths[k]
        if left or not lengths[k]:
            insort(room, (left, b))
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens (words), cluster (hash of the lower-cased word sequence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tv.slices(b.column("text")):
                w = tv.words(s)
                h = tv.hashes(w)
                total = np.zeros(len(h) + 1, np.uint64)
                place = np.arange(len(h), dtype=np.int64) - np.repeat(w.first[:-1], w.counts) + 1
                np.cumsum(tv.mix(h + tv.mix(place.astype(np.uint64))), out=total[1:])
                cluster = tv.mix(total[w.first[1:]] - total[w.first[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(s.lo, len(s)), b.column("source").slice(s.lo, len(s)), pa.array(w.counts, pa.int64()), pa.array(cluster.view(np.int64))],
                    names=["doc_id", "source", "n_tokens", "cluster"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("source"), "text").mapInArrow(run, "doc_id long, source string, n_tokens long, cluster long")


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, shard, bin_id, place for every piece of every row.

    A document without words (null, empty, blank) is one piece of no tokens. A
    null source is the source ''. Rows are dealt to shards by doc_id and text
    hash; repeated rows never share a bin, as they are of one cluster. Of pieces of one length the smaller
    doc_id (nulls last) is packed first, and of bins with the same room the older one is taken. Extra columns
    are ignored. An empty table packs to none."""
    spark = docs.sparkSession
    shards = max(1, -(-docs.count() // SHARD_ROWS))
    items = measured(docs).withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_shard: dict[int, list[tuple]] = {}
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "source", "n_tokens", "cluster"))):
                by_shard.setdefault(row[0], []).append(row[1:])
        for shard, rows in by_shard.items():
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3], r[1]))
            pieces = []
            for doc_id, source, n, cluster in rows:
                for k in range(max(1, -(-n // capacity))):
                    pieces.append((doc_id, k, k * capacity, min(capacity, n - k * capacity), source, cluster))
            placed = best_fit([p[3] for p in pieces], [p[4] for p in pieces], [p[5] for p in pieces], capacity, per_source)
            cols = [[p[i] for p in pieces] for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (*cols, [shard] * len(pieces), [x[0] for x in placed], [x[1] for x in placed])],
                names=["doc_id", "piece", "first_token", "n_tokens", "shard", "bin_id", "place"],
            )

    parts = max(shuffle_partitions(spark), min(shards, 100_000))
    return items.repartitionById(parts, F.pmod("shard", F.lit(parts))).mapInArrow(run, "doc_id long, piece long, first_token long, n_tokens long, shard long, bin_id long, place long")
