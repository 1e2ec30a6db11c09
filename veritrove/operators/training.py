"""Training a nested projection with mined negatives, in rounds of Spark jobs.

An example is a query's vector, its positive's and those of its mined negatives, joined on the workers and written once. A
step takes one share of the examples: every task sums losses and gradients of its examples in numpy, and Spark adds the
tasks' sums up row by row of the projection, so what comes to the driver is one gradient of fixed size, however many
examples a share has. There are as many shares as steps at most, each of `batch` examples at least, so all examples are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.operators.optimise import first_choice_rate
from veritrove.operators.simjoin import project_band
from veritrove.plans.session import released, written

# Nested dimensions, temperature, steps, batch, rate and share of queries held out.
DIMS, TEMPERATURE, STEPS, BATCH, RATE, DEV_SHARE = (64, 128, 256, 512), 0.02, 250, 128, 5e-4, 0.1
# The step at which the first-choice rate must have reached DEV_LEAST; steps without progress of PROGRESS after
# which training ends; the loss below which neither counts.
DEV_STEP, DEV_LEAST, PATIENCE, PROGRESS, LOSS_FLOOR = 100, 0.2, 60, 1e-4, 0.01


@dataclass
class Trained:
    """The projection W (largest dimension by base dimension) and how training went. stopped: '', 'dev' or 'plateau'."""

    w: np.ndarray
    loss: float
    dev_rate: float
    steps: int
    stopped: str = ""


def nested(dims: tuple[int, ...], base: int) -> tuple[int, ...]:
    """The dimensions that a base of so many has; the base itself if none fits."""
    return tuple(k for k in dims if k <= base) or (base,)


def examples(queries: DataFrame, band: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """a, q, p (array<double>), n (their negatives' vectors by slot, one after the other) of each query with both.

    queries and band have id and vec, positives a and b, negatives a, b and slot (see hard_negatives)."""
    vectors = band.where("vec is not null").select(F.col("id").alias("b"), F.col("vec").cast("array<double>").alias("v"))
    asked = queries.where("vec is not null").select(F.col("id").alias("a"), F.col("vec").cast("array<double>").alias("q"))
    right = positives.select("a", "b").join(vectors, "b").select("a", F.col("v").alias("p"))
    wrong = negatives.select("a", "b", "slot").join(vectors, "b").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("slot", "v"))).alias("n"))  # as many as there are slots
    return asked.join(right, "a").join(wrong, "a").select("a", "q", "p", F.flatten(F.transform("n", lambda x: x["v"])).alias("n"))


def losses_and_gradient(w: np.ndarray, q: np.ndarray, p: np.ndarray, n: np.ndarray, dims: tuple[int, ...], temperature: float = TEMPERATURE) -> tuple[np.ndarray, np.ndarray]:
    """Each example's loss, and the sum of the losses' gradients by w.

    q and p are (examples, d), n (examples, negatives, d). A loss is the mean over dims of the cross entropy of the positive
    among positive and negatives by cosine of the projections' leading dimensions."""
    x = np.concatenate([p[:, None], n], 1)
    yq, yx = q @ w.T, x @ w.T
    loss, grad = np.zeros(len(q)), np.zeros_like(w)
    flat = x.reshape(-1, x.shape[2])
    for k in dims:
        a, c = yq[:, :k], yx[:, :, :k]
        na, nc = np.maximum(np.linalg.norm(a, axis=1), 1e-12)[:, None], np.maximum(np.linalg.norm(c, axis=2), 1e-12)[:, :, None]
        a, c = a / na, c / nc
        s = np.einsum("bd,bkd->bk", a, c) / temperature
        s -= s.max(1, keepdims=True)
        total = np.exp(s).sum(1)
        loss += (np.log(total) - s[:, 0]) / len(dims)
        g = np.exp(s) / total[:, None]
        g[:, 0] -= 1
        g /= temperature * len(dims)
        ga, gc = np.einsum("bk,bkd->bd", g, c), g[:, :, None] * a[:, None]
        ga = (ga - a * (ga * a).sum(1, keepdims=True)) / na
        gc = (gc - c * (gc * c).sum(2, keepdims=True)) / nc
        grad[:k] += ga.T @ q + gc.reshape(-1, k).T @ flat
    return loss, grad


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, p, n = (np.asarray(b.column(c).flatten(), np.float64).reshape(b.num_rows, -1) for c in ("q", "p", "n"))
    return q, p, n.reshape(len(q), -1, q.shape[1])


def example_losses(some: DataFrame, w: np.ndarray, dims: tuple[int, ...], temperature: float = TEMPERATURE) -> DataFrame:
    """a, loss of each example under the projection w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                loss, _ = losses_and_gradient(w, *_arrays(b), dims, temperature)
                yield pa.RecordBatch.from_arrays([b.column("a"), pa.array(loss)], names=["a", "loss"])

    return some.select("a", "q", "p", "n").mapInArrow(run, f"a {some.schema['a'].dataType.simpleString()}, loss double")


def summed_gradient(some: DataFrame, w: np.ndarray, dims: tuple[int, ...], temperature: float = TEMPERATURE) -> tuple[int, float, np.ndarray]:
    """The number of examples, the sum of their losses, and that of their gradients, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, grad = 0, 0.0, np.zeros_like(w)
        for b in batches:
            if b.num_rows:
                loss, g = losses_and_gradient(w, *_arrays(b), dims, temperature)
                count, total, grad = count + len(loss), total + loss.sum(), grad + g
        if count:
            rows = [[count, total], *grad.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(grad)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["row", "g"])

    parts = some.select("q", "p", "n").mapInArrow(run, "row int, g array<double>")
    sums = parts.groupBy("row").agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")).collect()  # one row for each of w and one more
    out, count, total = np.zeros_like(w), 0, 0.0
    for r in sums:
        if r.row < 0:
            count, total = int(r.g[0]), r.g[1]
        else:
            out[r.row] = r.g
    return count, total, out


def dev_first_choice(w: np.ndarray, queries: DataFrame, band: DataFrame, positives: DataFrame) -> float:
    """The share of queries whose nearest row of the whole projected band is their positive."""
    rate = first_choice_rate(project_band(queries, w), project_band(band, w), positives).first()
    return float(rate["rate"])


def train(
    queries: DataFrame, band: DataFrame, positives: DataFrame, negatives: DataFrame, dims: tuple[int, ...] = DIMS, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 0, progress: Callable | None = None
) -> Trained:
    """Fits W by Adam on the examples of all queries but a tenth, by a hash of seed and id, which are held out.

    W starts from a normal distribution of variance 1 / base dimension. Training stops at step DEV_STEP if too few of the held-out queries
    have their positive as first choice in the whole band ('dev'), and after PATIENCE steps without a smaller loss ('plateau'),
    unless the loss is under LOSS_FLOOR. Too few queries for a batch are refused."""
    with released():
        return _rounds(queries, band, positives, negatives, dims, steps, batch, rate, seed, progress)


def _rounds(queries, band, positives, negatives, dims, steps, batch, rate, seed, progress) -> Trained:
    held = F.pmod(F.xxhash64(F.lit(seed), F.lit("dev"), "a"), F.lit(round(1 / DEV_SHARE))) == 0
    known = examples(queries, band, positives, negatives).withColumn("held", held)
    known = written(known, "examples")
    base, n, n_dev = known.agg(F.max(F.size("q")), F.count("*"), F.sum(F.col("held").cast("int"))).first()
    if n < batch:
        raise ValueError(f"{batch} queries are needed to train, not {n}")
    shares = max(1, min(steps, (n - n_dev) // batch))
    share = F.pmod(F.xxhash64(F.lit(seed), "a"), F.lit(shares)).alias("share")
    # in order of shares, so that a step reads the row groups of its own only
    learnt = written(known.where("not held").select("a", "q", "p", "n", share).repartitionByRange("share").sortWithinPartitions("share"), "shares")
    dev = known.where("held").select(F.col("a").alias("id"), F.col("q").alias("vec"))
    dev_positives = positives.join(dev.select(F.col("id").alias("a")), "a", "left_semi")

    dims = nested(dims, base)
    w = np.random.default_rng(seed).normal(0, base**-0.5, (max(dims), base))
    m, v = np.zeros_like(w), np.zeros_like(w)
    best, since, loss, stopped, step, dev_rate = np.inf, 0, 0.0, "", 0, None
    for step in range(1, steps + 1):
        count, total, grad = summed_gradient(learnt.where(F.col("share") == (step - 1) % shares), w, dims)
        if count:
            loss, grad = total / count, grad / count
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        best, since = (loss, 0) if loss < best - PROGRESS else (best, since + 1)
        if progress is not None:
            progress(step, loss, best)
        if step == DEV_STEP and n_dev and best >= LOSS_FLOOR:
            dev_rate = dev_first_choice(w, dev, band, dev_positives)
            if dev_rate < DEV_LEAST:
                stopped = "dev"
                break
        if since >= PATIENCE and best >= LOSS_FLOOR:
            stopped = "plateau"
            break
    if stopped != "dev":
        dev_rate = dev_first_choice(w, dev, band, dev_positives)
    return Trained(w, float(loss), dev_rate, step, stopped)
