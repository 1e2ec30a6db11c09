"""Approximate search: an inverted file over k-means cells, pruned by cell before the exact scores.

Optional, off by default: exact search is what results are held against."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrove.operators import simjoin
from veritrove.operators.search import top_k

#: Rows that the cells are fitted on at most; the index holds all rows.
FIT_ROWS = 100_000
#: Queries that the number of probes is measured on at most.
PROBE_QUERIES = 256


def fit_cells(band: DataFrame, cells: int, seed: int = 0) -> np.ndarray:
    """Centroids from a hash-ordered sample of bounded size."""
    n = band.count()
    some = band if n <= FIT_ROWS else band.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(-(-n // FIT_ROWS))) == 0)
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f").fit(some.select(array_to_vector(F.col("vec").cast("array<double>")).alias("f")))
    return np.array(model.clusterCenters())


def indexed(band: DataFrame, centroids: np.ndarray) -> DataFrame:
    """band with `cell`, its nearest centroid; write it partitioned by cell so that a search reads few of them."""

    def run(batches):
        for b in batches:
            x = np.asarray(b.column("vec").flatten(), np.float64).reshape(b.num_rows, -1)
            d = -2 * x @ centroids.T + (centroids**2).sum(1) if b.num_rows else np.zeros((0, len(centroids)))
            yield b.append_column("cell", pa.array(d.argmin(1).astype(np.int32)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in band.schema.fields) + ", cell int"
    return band.mapInArrow(run, schema)


def search(index: DataFrame, centroids: np.ndarray, q: list[float], k: int = 10, probes: int = 8) -> DataFrame:
    """The top k among the rows of the cells nearest to q."""
    near = np.argsort(((centroids - np.array(q)) ** 2).sum(1))[:probes]
    return top_k(index.where(F.col("cell").isin([int(c) for c in near])).drop("cell"), q, k)


def _ranked(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cells of each row of x, the nearest first."""
    return np.argsort(-2 * x @ centroids.T + (centroids**2).sum(1), axis=1, kind="stable")


def probes_for(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 10, recall: float = 0.95) -> int:
    """The fewest probes whose recall, against exact search for at most PROBE_QUERIES of the queries, is at least this."""
    some = queries.orderBy(F.xxhash64("id"), "id").limit(PROBE_QUERIES).select("id", "vec")
    vecs = {r["id"]: list(r["vec"]) for r in some.collect()}
    fixed = queries.sparkSession.createDataFrame(list(vecs.items()), "id long, vec array<double>") if vecs else some
    hits = simjoin.nearest(fixed, index.select("id", "vec"), k).join(index.select(F.col("id").alias("b"), "cell"), "b").select("a", "cell").collect()
    if not hits:
        return len(centroids)
    order = _ranked(np.array([vecs[r["a"]] for r in hits], np.float64), centroids)
    at = (order == np.array([r["cell"] for r in hits])[:, None]).argmax(1)
    reached = np.cumsum(np.bincount(at, minlength=len(centroids))) / len(hits)
    return int(np.argmax(reached >= recall)) + 1


def best_rows(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Dot products and numbers of the k best rows of y for each of x, -inf where there are fewer; few products are held at once."""
    best, at = np.full((len(x), k), -np.inf), np.full((len(x), k), -1, np.int64)
    for s in range(0, len(x), simjoin.BLOCK):
        for t in range(0, len(y), simjoin.BLOCK):
            e = s + simjoin.BLOCK
            simjoin.best_of(x[s:e] @ y[t : t + simjoin.BLOCK].T, t, best[s:e], at[s:e])
    return best, at


def search_all(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 8, block: int = 8 * simjoin.BLOCK) -> DataFrame:
    """a, b, cosine, rank of the top k of each query (id, vec) among the rows of its nearest cells.

    Rows and queries of a cell are cut into parts of about `block` by the ids' hash and meet in a grid, so a large cell is spread
    over many tasks; k rows a query leave each of them, and BLOCK by BLOCK dot products are held at once."""

    def probed(batches):
        for b in batches:
            x = np.asarray(b.column("vec").flatten(), np.float64).reshape(b.num_rows, -1)
            near = _ranked(x, centroids)[:, :probes] if b.num_rows else np.zeros((0, probes))
            yield b.append_column("cells", pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())))

    typed = lambda df, *more: df.where("id is not null and vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), *more)
    rows = typed(index, "cell")
    asked = typed(queries).mapInArrow(probed, "id long, vec array<double>, cells array<int>").select("id", "vec", F.explode("cells").alias("cell"))

    def parts(df: DataFrame) -> Column:
        """How many parts the row's cell has on this side."""
        sizes = {r["cell"]: r["count"] for r in df.groupBy("cell").count().collect()}  # a number for each cell
        return F.get(F.array(*(F.lit(max(1, -(-sizes.get(c, 0) // block))).cast("long") for c in range(len(centroids)))), F.col("cell"))

    own, other = parts(asked), parts(rows)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    q = asked.withColumn("g", F.pmod(F.xxhash64("id"), own)).withColumn("h", every(other))
    r = rows.withColumn("h", F.pmod(F.xxhash64("id"), other)).withColumn("g", every(own))

    def run(key, one, two):
        out = {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())}
        if one.num_rows and two.num_rows:
            (i, x), (j, y) = simjoin._matrix(one), simjoin._matrix(two)
            best, at = best_rows(x, y, k)
            p, c = np.nonzero(np.isfinite(best))
            out = {"a": i.take(pa.array(p)), "b": j.take(pa.array(at[p, c])), "cosine": pa.array(best[p, c])}
        return pa.table(out)

    found = q.groupBy("cell", "g", "h").cogroup(r.groupBy("cell", "g", "h")).applyInArrow(run, "a long, b long, cosine double")
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
