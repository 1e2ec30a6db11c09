"""Jaccard of the sets of given pairs of rows, without sending a set once for each pair.

An item that only one set has is in no intersection, so it counts in that set's size and is dropped. What is left is dealt to
stripes by the ids' hash, and a cell of the grid gets the sets of two stripes and the pairs between them: a set is sent once
to each cell of its stripe, however many pairs it is in. Stripes are as large as a task's memory allows, and cells are taken
in rounds, whose shuffles go before the next one begins, so the disk that is taken doesn't grow with the square of the sets; only the pairs do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.plans.session import written

#: Bytes of items in a stripe, pairs in a cell and bytes of all items that are looked up at once, about.
STRIPE_BYTES, CELL_PAIRS, LOOKED_UP = 32 << 20, 1 << 21, 1 << 20
#: Bytes sent in a round where all sets together are smaller than half of that, else twice the sets.
ROUND_BYTES = 512 << 20
#: Bytes of a pair, and of a set besides its items.
PAIR, SET = 32, 48


def shared_items(sets: DataFrame) -> DataFrame:
    """id, n (all items), items (those that another set has too, ascending) of sets with a number (set), id and items."""
    each = sets.select("set", F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("sets")).where("sets > 1").select("item")
    kept = each.join(often, "item", "left_semi").groupBy("set").agg(F.sort_array(F.collect_list("item")).alias("items"))
    sizes = sets.select("set", "id", F.array_size("items").cast("double").alias("n"))
    return sizes.join(kept, "set", "left").select("id", "n", F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def intersections(start: np.ndarray, items: np.ndarray, u: np.ndarray, v: np.ndarray, most: int = LOOKED_UP) -> np.ndarray:
    """How many items sets u[k] and v[k] share; set s is items[start[s] : start[s + 1]], ascending."""
    out, size = np.zeros(len(u), np.int64), np.diff(start)
    some = np.flatnonzero((size[u] > 0) & (size[v] > 0))
    some = some[np.argsort(u[some], kind="stable")]
    # a run of pairs with one left set, cut where the right ones have too many items
    cut = np.r_[0, np.flatnonzero(np.diff(u[some])) + 1, len(some)] if len(some) else np.zeros(1, np.int64)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        x = items[start[u[some[lo]]] : start[u[some[lo]] + 1]]
        ends = np.cumsum(size[v[some[lo:hi]]])
        parts = [some[lo:hi]] if ends[-1] <= most else np.split(some[lo:hi], np.flatnonzero(np.diff(ends // most)) + 1)
        for k in parts:
            first, n = start[v[k]], size[v[k]]
            ends = np.cumsum(n)
            y = items[np.arange(ends[-1]) + np.repeat(first - ends + n, n)]
            hits = np.r_[0, np.cumsum(x.take(np.searchsorted(x, y), mode="clip") == y)]
            out[k] = hits[ends] - hits[ends - n]
    return out


def grid_of(item_bytes: int, pairs: int, cores: int) -> int:
    """Stripes: as few as memory and cores allow."""
    return max(1, -(-item_bytes // STRIPE_BYTES), math.ceil(math.sqrt(2 * pairs / CELL_PAIRS)), math.ceil(math.sqrt(2 * cores)))


def jaccards(pairs: DataFrame, sets: DataFrame, most: float) -> DataFrame:
    """a, b, cosine, jaccard of pairs (a, b, cosine) whose sets (set, id, items) have a Jaccard of `most` at most; 1 where either has no items (null).

    pairs and sets are read several times, so both should be written tables. items are 64-bit numbers, distinct in a set."""
    kind = pairs.schema["a"].dataType.simpleString()
    sets = sets.withColumn("id", F.col("id").cast(kind))
    own = written(shared_items(sets), "shared")
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    n, whole = (v or 0 for v in sets.agg(F.count("*"), F.sum(F.array_size("items"))).first())
    kept = own.agg(F.sum(F.array_size("items"))).first()[0] or 0
    count = pairs.count()
    stripes = grid_of(8 * kept + SET * n, count, cores)
    sent = (stripes + 1) * (8 * kept + SET * n) + PAIR * count
    rounds = min(stripes, -(-sent // max(ROUND_BYTES, 2 * (8 * whole + SET * n))) or 1)

    def cell(key, one: pa.Table, two: pa.Table) -> pa.Table:
        lists = one.column("items").combine_chunks() if one.num_rows else pa.array([], pa.list_(pa.int64()))
        start = np.r_[0, np.cumsum([] if not len(lists) else lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        items, size = lists.flatten().to_numpy(), one.column("n").to_numpy()
        known = pd.DataFrame({"id": one.column("id").to_pandas(), "row": np.arange(one.num_rows)})
        met = two.select(["a", "b", "cosine"]).to_pandas()
        for c, row in (("a", "u"), ("b", "v")):
            met = met.merge(known.rename(columns={"id": c, "row": row}), on=c)
        u, v = met["u"].to_numpy(np.int64), met["v"].to_numpy(np.int64)
        both = intersections(start, items, u, v)
        with np.errstate(invalid="ignore"):
            jaccard = both / (size[u] + size[v] - both)
        jaccard[np.isnan(size[u]) | np.isnan(size[v])] = 1.0
        ok = jaccard <= most
        return pa.table({c: pa.array(x[ok], t) for c, x, t in (("a", met["a"].to_numpy(), two.schema.field("a").type), ("b", met["b"].to_numpy(), two.schema.field("b").type), ("cosine", met["cosine"].to_numpy(), pa.float64()), ("jaccard", jaccard, pa.float64()))})

    def stripe(c: str):
        return F.pmod(F.xxhash64(c), F.lit(stripes))

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long")))
    rows = own.withColumn("g", stripe("id")).withColumn("h", every).select("id", "n", "items", F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"))
    between = pairs.select("a", "b", "cosine", F.least(stripe("a"), stripe("b")).alias("g"), F.greatest(stripe("a"), stripe("b")).alias("h"))
    found = None
    for k in range(rounds):
        mine = (F.col("g") + F.col("h")) % rounds == k
        part = rows.where(mine).groupBy("g", "h").cogroup(between.where(mine).groupBy("g", "h")).applyInArrow(cell, f"a {kind}, b {kind}, cosine double, jaccard double")
        part = part if rounds == 1 else written(part, "overlap")
        found = part if found is None else found.union(part)
    return found
