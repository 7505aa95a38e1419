"""Connected components of a link table by Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def spanning(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: in each partition, every node is tied to its least local neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while up.setdefault(top, top) != top:
                top = up[top]
            while up[x] != top:
                up[x], x = top, up[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        tied = [(x, root(x)) for x in list(up)]
        tied = [(x, r) for x, r in tied if x != r]
        for i in range(0, len(tied), 50_000):
            part = tied[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b; longs) touches; the root is the least node it can reach.

    Each round takes the least label among a node's neighbours and then the label of that label, until nothing
    changes; rounds are cut by checkpoints. Rounds grow with the logarithm of the longest path.
    """
    tied = spanning(edges.where(F.col("a") != F.col("b")))
    both = saved(tied.unionAll(tied.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "m").alias("low"), "root")
        jump = labels.select(F.col("node").alias("_at"), F.col("root").alias("_up"))
        moved = hooked.join(jump, F.col("low") == F.col("_at")).select("node", F.least("low", "_up").alias("root"), F.col("root").alias("before"))
        moved = saved(moved)
        labels = moved.select("node", "root")
        if moved.where("root <> before").isEmpty():
            return labels
