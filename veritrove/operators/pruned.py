"""Threshold joins of unit vectors that rule out what can't be similar before it is sent or multiplied; exact.

Angles obey the triangle inequality: if x and y are within an angle t, their angles to any pivot differ by t at most. A few
pivots are taken from a sample, rows go to stripes with their nearest pivot (large ones are cut by a hash of the id, so no
stripe is hot), and of each stripe the least and the largest angle to every pivot are found. Two stripes whose ranges lie
further apart than t for any pivot are no cell of the grid: their rows are never sent there. Within a cell rows are
ordered by their nearest pivots, and blocks are ruled out in the same way before they are multiplied. Where the
data don't cluster nothing is ruled out and the join is the plain grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrove.operators import simjoin
from veritrove.plans.session import written

#: Pivots, rows that they are chosen from, and rows of a block.
PIVOTS, SAMPLE, BLOCK = 48, 4096, 512
#: What rounding may do to an angle.
SLACK = 1e-6


@dataclass
class Plan:
    """Stripes of both sides, and which cells of their grid are left."""

    kept: np.ndarray  # left stripes by right stripes

    @property
    def skipped(self) -> float:
        """The share of cells that are ruled out."""
        return 1 - float(self.kept.mean()) if self.kept.size else 0.0


def choose_pivots(rows: DataFrame, most: int = PIVOTS, seed: int = 0) -> np.ndarray:
    """Unit vectors of a sample of fixed size, each the furthest from those chosen before."""
    some = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).select("vec").collect()
    x = np.array([list(r.vec) for r in some], np.float64)
    n = np.linalg.norm(x, axis=1) if len(x) else np.zeros(0)
    x = x[n > 0] / n[n > 0, None]
    if not len(x):
        return np.zeros((0, 1))
    at, nearest = [0], x @ x[0]
    while len(at) < min(most, len(x)) and nearest.min() < 1 - 1e-9:
        at.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[at[-1]])
    return x[at]


def angles(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The angle of each row to each pivot, and the rows' lengths. A row of length 0 counts as at right angles to all."""
    n = np.linalg.norm(x, axis=1)
    return np.arccos(np.clip(x @ pivots.T / np.maximum(n, 1e-300)[:, None], -1, 1)), n


def apart(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """The least angle that ranges (rows by pivots) allow between each row of the first and each of the second."""
    gap = np.zeros((len(low), len(low2)))
    for k in range(low.shape[1]):
        gap = np.maximum(gap, np.maximum(low[:, k, None] - high2[None, :, k], low2[None, :, k] - high[:, k, None]))
    return gap


def widest(threshold: float, length: np.ndarray, length2: np.ndarray) -> np.ndarray:
    """The largest angle at which vectors up to these lengths reach the threshold (over 0)."""
    return np.arccos(np.clip(threshold / np.maximum(length[:, None] * length2[None, :], 1e-300), -1, 1)) + SLACK


def _assigned(rows: DataFrame, pivots: np.ndarray, stripe_rows: int) -> tuple[DataFrame, int]:
    """id, vec, stripe of all rows, and the number of stripes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("vec").flatten(), np.float64).reshape(b.num_rows, -1)
                yield b.append_column("pivot", pa.array((x @ pivots.T).argmax(1).astype(np.int32)))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    near = written(rows.mapInArrow(run, f"id {kinds['id']}, vec {kinds['vec']}, pivot int"), "near")
    counts = {r["pivot"]: r["count"] for r in near.groupBy("pivot").count().collect()}  # one for each pivot
    parts = [-(-counts.get(k, 0) // stripe_rows) for k in range(len(pivots))]
    first = np.r_[0, np.cumsum(parts)]
    of = lambda numbers: F.get(F.array(*(F.lit(int(v)).cast("long") for v in numbers)), F.col("pivot"))
    stripe = of(first[:-1]) + F.pmod(F.xxhash64("id"), of([max(1, p) for p in parts]))
    return near.select("id", "vec", stripe.alias("stripe")), int(first[-1])


def _ranges(rows: DataFrame, pivots: np.ndarray, stripes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and largest angle of each stripe to each pivot, and the largest length in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("vec").flatten(), np.float64).reshape(b.num_rows, -1)
            at = b.column("stripe").to_numpy()
            order = np.argsort(at, kind="stable")
            found, starts = np.unique(at[order], return_index=True)
            a, n = angles(x[order], pivots)
            low, high, length = np.minimum.reduceat(a, starts), np.maximum.reduceat(a, starts), np.maximum.reduceat(n, starts)
            k = len(pivots)
            columns = [np.repeat(found, k), np.tile(np.arange(k), len(found)), low.ravel(), high.ravel(), np.repeat(length, k)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["stripe", "pivot", "low", "high", "length"])

    parts = rows.select("vec", "stripe").mapInArrow(run, "stripe long, pivot long, low double, high double, length double")
    low, high, length = np.full((stripes, len(pivots)), np.inf), np.full((stripes, len(pivots)), -np.inf), np.zeros(stripes)
    # a number for each stripe and pivot
    for r in parts.groupBy("stripe", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("length").alias("length")).collect():
        low[r.stripe, r.pivot], high[r.stripe, r.pivot], length[r.stripe] = r.low, r.high, r.length
    return low, high, length


def in_order(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """An order of rows in which those with the same two nearest pivots follow one another, by angle."""
    a, _ = angles(x, pivots)
    near = np.argsort(a, axis=1, kind="stable")
    return np.lexsort((a[np.arange(len(a)), near[:, 0]], near[:, min(1, near.shape[1] - 1)], near[:, 0]))


def multiplied_blocks(x: np.ndarray, y: np.ndarray, pivots: np.ndarray, threshold: float, own: bool, block: int = BLOCK) -> Iterator[tuple[slice, slice]]:
    """The blocks of rows of x and y that may hold similar ones; of blocks of the same rows each pair once."""
    side = []
    for z in (x, y):
        a, n = angles(z, pivots)
        starts = np.arange(0, len(z), block)
        side.append((np.minimum.reduceat(a, starts), np.maximum.reduceat(a, starts), np.maximum.reduceat(n, starts)))
    (low, high, n), (low2, high2, n2) = side
    near = apart(low, high, low2, high2) <= widest(threshold, n, n2)
    for i, j in zip(*np.nonzero(near)):
        if not own or i <= j:
            yield slice(i * block, (i + 1) * block), slice(j * block, (j + 1) * block)


def _spread(rows: DataFrame, kept: np.ndarray, own: str, other: str) -> DataFrame:
    """Each row once for each cell of its stripe that is left."""
    to = [(k, np.flatnonzero(kept[k]).tolist()) for k in range(len(kept))]
    cells = rows.sparkSession.createDataFrame(to, "stripe long, cells array<long>")
    # named anew, as both sides may come from one table
    return rows.join(cells, "stripe").select(F.col("id").alias("id"), F.col("vec").alias("vec"), F.col("stripe").alias(own), F.explode("cells").alias(other))


def similar(left: DataFrame, right: DataFrame | None, threshold: float, pivots: int = PIVOTS, stripe_rows: int | None = None, block: int = BLOCK) -> tuple[DataFrame, Plan]:
    """a, b, cosine of all pairs with a dot product of at least the threshold, and what was ruled out.

    With right None the pairs a < b within left. The threshold must be over 0; vectors are of about unit length (longer ones widen
    the angle that is allowed for, so the result is exact for any). Rows without id or vec are left out."""
    if threshold <= 0:
        raise ValueError("a threshold over 0 is needed to rule anything out")
    a = simjoin._plain(left)
    b = a if right is None else simjoin._plain(right)
    p = choose_pivots(a, pivots)
    kind_a, kind_b = (x.schema["id"].dataType.simpleString() for x in (a, b))
    if not len(p) or p.shape[1] != (b.agg(F.max(F.size("vec"))).first()[0] or 0):
        empty = left.sparkSession.createDataFrame([], f"a {kind_a}, b {kind_b}, cosine double")
        return empty, Plan(np.zeros((0, 0), bool))
    size = stripe_rows or max(simjoin.BLOCK, simjoin.STRIPE_BYTES // (8 * p.shape[1]))
    rows, ranges = _side(a, p, size)
    cols, ranges2 = (rows, ranges) if right is None else _side(b, p, size)
    kept = apart(*ranges[:2], *ranges2[:2]) <= widest(threshold, ranges[2], ranges2[2])
    if right is None:
        kept = np.triu(kept)
    half = right is None

    def cell(key, one, other):
        i, x = simjoin._matrix(one)
        j, y = simjoin._matrix(other)
        parts = []
        if len(i) and len(j):
            own = half and key[0].as_py() == key[1].as_py()
            order, order2 = in_order(x, p), in_order(y, p)
            x, y, i, j = x[order], y[order2], i.take(pa.array(order)), j.take(pa.array(order2))
            for s, t in multiplied_blocks(x, y, p, threshold, own, block):
                dots = x[s] @ y[t].T
                u, v = np.nonzero(dots >= threshold)
                c, u, v = dots[u, v], u + s.start, v + t.start
                parts.append(tuple(z[u < v] for z in (u, v, c)) if own else (u, v, c))
        u, v, c = (np.concatenate([np.zeros(0, np.int64 if k < 2 else float), *(z[k] for z in parts)]) for k in range(3))
        return pa.table({"a": i.take(pa.array(u.astype(np.int64))), "b": j.take(pa.array(v.astype(np.int64))), "cosine": pa.array(c, pa.float64())})

    g, h = _spread(rows, kept, "g", "h"), _spread(cols, kept.T, "h", "g")
    found = g.groupBy("g", "h").cogroup(h.groupBy("g", "h")).applyInArrow(cell, f"a {kind_a}, b {kind_b}, cosine double")
    if half:
        first: Column = F.least("a", "b")
        found = found.select(first.alias("a"), F.greatest("a", "b").alias("b"), "cosine")
    return found, Plan(kept if not half else kept[np.triu_indices(len(kept))])


def _side(rows: DataFrame, pivots: np.ndarray, size: int) -> tuple[DataFrame, tuple]:
    assigned, stripes = _assigned(rows, pivots, size)
    return assigned, _ranges(assigned, pivots, stripes)
