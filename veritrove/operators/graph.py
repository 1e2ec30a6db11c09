"""Approximate search by small-world graphs: one for each shard of a band, built and searched on the workers.

Rows are dealt to shards by a hash, so shards are alike in size however the data cluster. In a shard each row is linked
to near rows that are nearer to it than to one another (so links lead in all directions), back from what links to it,
and to a few at random. A search holds a beam of the best rows met so far for each query and follows the links of the
best ones not yet followed, for all of a block's queries at once in numpy, until the whole beam has been followed. The best
k of all shards are the result. A shard is one row of plain arrays, so an index is a table: it is written, read and
checked like any other, beside the band. Where the result must be exact, completed() holds all rows against the kth best found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrove.operators import simjoin

#: Rows of a shard and queries of a block, about.
SHARD_ROWS, QUERY_ROWS = 32_768, 8_192
#: Links of a row; random ones among them; rows that a search begins at; links followed at once.
DEGREE, AT_RANDOM, ENTRIES, FOLLOWED = 48, 4, 64, 4
# Rows above which an index is worth building, and the beam that a search keeps.
LEAST_ROWS, BEAM = 5_000, 128
#: What vectors held as floats may do to a dot product of unit vectors.
ROUNDED = 1e-6
_SCHEMA = "shard long, dim int, ids array<long>, vecs array<float>, links array<int>"


def worth_building(rows: int) -> bool:
    return rows > LEAST_ROWS


def near_rows(x: np.ndarray, most: int, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """For each row the numbers and dot products of its `most` nearest others, the nearest first."""
    most = min(most, len(x) - 1)
    at, dots = np.zeros((len(x), max(0, most)), np.int32), np.zeros((len(x), max(0, most)), np.float32)
    for s in range(0, len(x) if most > 0 else 0, block):
        d = x[s : s + block] @ x.T
        d[np.arange(len(d)), np.arange(s, s + len(d))] = -np.inf
        best = np.argpartition(-d, most - 1, axis=1)[:, :most]
        d = np.take_along_axis(d, best, 1)
        order = np.argsort(-d, axis=1, kind="stable")
        at[s : s + block], dots[s : s + block] = np.take_along_axis(best, order, 1), np.take_along_axis(d, order, 1)
    return at, dots


def spread_links(x: np.ndarray, at: np.ndarray, dots: np.ndarray, most: int, block: int = 256) -> np.ndarray:
    """Which of each row's near rows stay: those no nearer to one that stays before them than to the row; `most` at most."""
    keep = np.zeros(at.shape, bool)
    for s in range(0, len(x), block):
        near = x[at[s : s + block]]
        between = np.einsum("nid,njd->nij", near, near)
        own, kept = dots[s : s + block], keep[s : s + block]
        for j in range(at.shape[1]):
            hidden = (kept[:, :j] & (between[:, j, :j] > own[:, j, None])).any(1)
            kept[:, j] = ~hidden & (kept[:, :j].sum(1) < most)
    return keep


def linked(x: np.ndarray, degree: int = DEGREE, seed: int = 0, block: int = 2048) -> np.ndarray:
    """The links of each row (rows by degree, -1 where there are fewer), chosen for a block of rows at a time."""
    n = len(x)
    out = np.full((n, degree), -1, np.int32)
    at, dots = near_rows(x, 2 * degree)
    if not at.shape[1]:
        return out
    keep = spread_links(x, at, dots, degree // 2)
    near = degree - AT_RANDOM
    row, to, dot = np.nonzero(keep)[0].astype(np.int32), at[keep], dots[keep]
    by = np.argsort(to, kind="stable")
    back, back_to, back_dot = to[by], row[by], dot[by]
    for s in range(0, n, block):
        e = min(n, s + block)
        # links there and back, what stays of the row's own first, then those to it, then its other near rows; within each by nearness
        i, j = np.searchsorted(row, (s, e))
        k, m = np.searchsorted(back, (s, e))
        left, place = np.nonzero(~keep[s:e])
        edges = np.concatenate(
            [
                np.stack([r, t, np.full(len(r), kind), -d * 1e6], 1)
                for kind, r, t, d in ((0, row[i:j], to[i:j], dot[i:j]), (1, back[k:m], back_to[k:m], back_dot[k:m]), (2, left + s, at[s:e][left, place], dots[s:e][left, place]))
            ]
        )
        edges = edges[np.lexsort((edges[:, 3], edges[:, 2], edges[:, 1], edges[:, 0]))]
        new = np.ones(len(edges), bool)
        new[1:] = (edges[1:, :2] != edges[:-1, :2]).any(1)
        edges = edges[new]
        edges = edges[np.lexsort((edges[:, 3], edges[:, 2], edges[:, 0]))].astype(np.int64)
        rank = np.arange(len(edges)) - np.searchsorted(edges[:, 0], edges[:, 0])
        take = rank < near
        out[edges[take, 0], rank[take]] = edges[take, 1]
    out[:, near:] = np.random.default_rng(seed).integers(0, n, (n, AT_RANDOM))
    return out


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, k: int, beam: int = BEAM, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and dot products of about the k best rows of each query, the best first; -1 where there are fewer."""
    beam, n = max(beam, k), len(x)
    at, best = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf)
    entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))
    for s in range(0, len(q) if n else 0, block):
        ask = q[s : s + block]
        rows = np.arange(len(ask))
        seen = np.zeros((len(ask), n), bool)
        seen[:, entries] = True
        ids = np.broadcast_to(entries, (len(ask), len(entries)))
        dots, done = ask @ x[entries].T, np.zeros((len(ask), len(entries)), bool)
        while True:
            order = np.argsort(-dots, axis=1, kind="stable")[:, :beam]
            ids, dots, done = (np.take_along_axis(v, order, 1) for v in (ids, dots, done))
            todo = np.where(done | np.isneginf(dots), -np.inf, dots)
            pick = np.argsort(-todo, axis=1, kind="stable")[:, :FOLLOWED]
            open_ = ~np.isneginf(np.take_along_axis(todo, pick, 1))
            if not open_.any():
                break
            np.put_along_axis(done, pick, True, 1)
            to = links[np.take_along_axis(ids, pick, 1)]
            to = np.where(open_[:, :, None], to, -1).reshape(len(ask), -1).astype(np.int64)
            fresh = (to >= 0) & ~seen[rows[:, None], to]
            # the same row may be linked twice in a step
            order = np.argsort(to, axis=1, kind="stable")
            sorted_ = np.take_along_axis(to, order, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
            fresh &= ~twice
            seen[np.nonzero(fresh)[0], to[fresh]] = True
            found = np.einsum("qd,qkd->qk", ask, x[to])
            found[~fresh] = -np.inf
            ids, dots, done = np.concatenate([ids, to], 1), np.concatenate([dots, found], 1), np.concatenate([done, ~fresh], 1)
        m = min(k, ids.shape[1])
        found = ~np.isneginf(dots[:, :m])
        at[s : s + block, :m] = np.where(found, ids[:, :m], -1)
        best[s : s + block, :m] = np.where(found, dots[:, :m], -np.inf)
    return at, best


def build(band: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, seed: int = 0) -> DataFrame:
    """One row for each shard of a band of unit vectors: shard, dim, and ids, vecs, links, flat and in the order of ids.

    Rows without an id or a vector are left out; an empty band has no shard."""
    rows = band.where("id is not null and vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
    shards = max(1, -(-rows.count() // shard_rows))

    def run(key, t):
        ids, x = simjoin._matrix(t)
        links = linked(x.astype(np.float32), degree, seed)
        flat = lambda v, kind: pa.array([v.ravel()], pa.list_(kind))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([x.shape[1]], pa.int32()), "ids": flat(ids.to_numpy(), pa.int64()), "vecs": flat(x.astype(np.float32), pa.float32()), "links": flat(links, pa.int32())})

    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).groupBy("shard").applyInArrow(run, _SCHEMA)


def check(index: DataFrame, rows: int, dim: int) -> None:
    """Refuses an index that doesn't hold so many rows of so many dimensions, or whose arrays don't fit together."""
    found = index.agg(
        F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("rows"),
        F.count_if((F.col("dim") != dim) | (F.size("vecs") != F.size("ids") * F.col("dim")) | (F.size("links") % F.size("ids") != 0)).alias("odd"),
    ).first()
    if found.rows != rows or found.odd:
        raise ValueError(f"the index has {found.rows} rows and {found.odd} odd shards; {rows} rows of {dim} dimensions are needed")


def save(index: DataFrame, path: str) -> None:
    """Writes an index; a reader takes whole shards."""
    index.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, rows: int, dim: int) -> DataFrame:
    """Reads an index and checks it against the band's size."""
    index = spark.read.parquet(path)
    check(index, rows, dim)
    return index


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """a, b, cosine, rank of about the k nearest rows of each query (id, vec); ties go to the smaller id.

    Every shard is asked for every query, in blocks of queries, and sends k rows for each."""
    asked = queries.where("id is not null and vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    parts = max(1, -(-asked.count() // query_rows))
    shards = index.select("shard").distinct().count()  # a number, not the shards
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(shards, 1) - 1).cast("long"))))
    spread = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def run(key, one, other):
        out = {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())}
        if one.num_rows and other.num_rows:
            ids, q = simjoin._matrix(one)
            row = {c: other.column(c).combine_chunks()[0].values for c in ("ids", "vecs", "links")}
            b = row["ids"].to_numpy()
            x, links = row["vecs"].to_numpy().reshape(len(b), -1), row["links"].to_numpy().reshape(len(b), -1)
            at, best = beam_search(x, links, q.astype(np.float32), k, beam)
            p, j = np.nonzero(at >= 0)
            cosine = np.einsum("nd,nd->n", q[p], x[at[p, j]].astype(np.float64))
            out = {"a": ids.take(pa.array(p)), "b": pa.array(b[at[p, j]]), "cosine": pa.array(cosine)}
        return pa.table(out)

    found = asked.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInArrow(run, "a long, b long, cosine double")
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact pairs (a, b) that were found."""
    hit = exact.select("a", "b").join(found.select("a", "b").withColumn("hit", F.lit(1)), ["a", "b"], "left")
    return float(hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0))).first()[0])


def completed(found: DataFrame, queries: DataFrame, band: DataFrame, k: int = 10) -> DataFrame:
    """a, b, cosine, rank of exactly the k nearest rows: each row of the band that reaches the kth best found by a search is ranked.

    The index has vectors as floats, so the bound is lower by what that may do to unit vectors."""
    length = F.sqrt(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v))
    asked = queries.where("vec is not null").select(F.col("id").alias("a"), length.alias("length"))
    kth = found.where(F.col("rank") == k).join(asked, "a").select("a", (F.col("cosine") - ROUNDED * F.col("length")).alias("bound"))
    return simjoin.nearest(queries, band, k, bound=kth)


def retrieve(queries: DataFrame, band: DataFrame, index: DataFrame | None = None, projection: np.ndarray | None = None, k: int = 10, exact: bool = False) -> DataFrame:
    """a, b, cosine, rank: by the index where there is one, completed if exact, else exactly. With a projection the queries are the base band's."""
    asked = simjoin.project_band(queries, projection) if projection is not None else queries
    if index is not None:
        found = search(index, asked, k)
        return completed(found, asked, band, k) if exact else found
    return simjoin.nearest(asked, band, k)


def index_of(band: DataFrame, rows: int | None = None) -> DataFrame | None:
    """An index where the band is large enough for one."""
    n = band.count() if rows is None else rows
    return build(band) if worth_building(n) else None


def links_of(index: DataFrame) -> DataFrame:
    """id, link: an index's edges as rows, to look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = b.column("ids")[k].values.to_numpy()
                links = b.column("links")[k].values.to_numpy().reshape(len(ids), -1)
                p, j = np.nonzero(links >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(ids[links[p, j]])], names=["id", "link"])

    return index.select("ids", "links").mapInArrow(run, "id long, link long")
