"""Connected components over an edge table, by hashing labels to the minimum."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.plans.session import written


#: Edges that one task's memory surely holds: about 100 MB of Python objects.
LOCAL_EDGES = 400_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of the task; roots are the smallest nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(root, nodes), pa.int64())], names=["node", "component"])


def components(edges: DataFrame, src: str = "src", dst: str = "dst", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): component is the smallest node reachable, itself included.

    Nodes without an edge are not listed. Each round lets every node take the
    smallest label among its neighbours, then jumps to the label of its label;
    the second halves the distance to the root, so a chain of length L needs
    O(log L) rounds. Labels are written to the shared folder each round, so a
    lost executor costs one round at most. Null ends are ignored. No more than
    LOCAL_EDGES edges are joined up in one task at once instead."""
    e = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    e = written(e, "edges")
    if e.count() <= local_edges:
        small = e.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1)
        return written(small.mapInArrow(_joined, "node long, component long"), "labels")
    both = written(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels"
    )
    while True:
        seen = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "component")
        near = seen.union(labels).groupBy("node").agg(F.min("component").alias("to"))
        root = labels.select(F.col("node").alias("to"), F.col("component").alias("up"))
        moved = near.join(root, "to").select("node", F.least("to", "up").alias("now"))
        both_labels = moved.join(labels, "node").select("node", F.col("now").alias("component"), (F.col("now") < F.col("component")).alias("changed"))
        after = written(both_labels, "labels")
        labels = after.select("node", "component")
        if after.where("changed").isEmpty():
            return labels
