"""Operator 11: k-means on whole numbers with a table of pivot distances (LAESA).

The distances of every vector to a few fixed pivots are computed and stored once. In each round the distances of
the centroids to the same pivots bound every vector's distance to every centroid from below: by the triangle
inequality it is at least the difference of both distances to a pivot. Centroids are looked at in the order of
their bounds; those whose bound exceeds the best distance found are out, the others get exact integer distances.
The pivots only steer the work: any choice gives the same clusters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .integers import LARGEST, Sums, integer_vectors, is_plain, matrix, moved, parsed, read, square, summed

CENTROIDS, ROUNDS, SCALE, DIMENSION = 16, 3, 64, 64
#: Pivots, and the vectors of the least hashes that they are chosen from.
PIVOTS, PIVOT_SAMPLE = 8, 1_000
#: What double rounding may add to a bound: distances stay below 2**37, so their errors below 2**-14.
SLACK = 1e-3


def _kept(scale: int, dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, plain, text = integer_vectors(batch.column(1), scale, dimension)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(plain, pa.binary()), pa.array(text, pa.string())], names=["vec_id", "v", "big"])

    return run


def far_apart(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different points, each the farthest from those before it."""
    if not len(points):
        return points
    chosen, near = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], 1).astype(float)) if len(pivots) else np.zeros((len(x), 0))


class Centroids:
    """The centroids of a round: those of plain size with their pivot distances, the others as exact integers."""

    def __init__(self, all_: list[list[int]], pivots: np.ndarray):
        self.all = all_
        self.plain = np.array([i for i, c in enumerate(all_) if is_plain(c)], np.int64)
        self.matrix = np.array([all_[i] for i in self.plain], np.int64).reshape(len(self.plain), pivots.shape[1])
        self.far = [i for i, c in enumerate(all_) if not is_plain(c)]
        self.table = to_pivots(self.matrix, pivots)

    def nearest(self, x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each vector, and how many exact distances it took."""
        best, found, looked = np.full(len(x), LARGEST), np.zeros(len(x), np.int64), 0
        low = np.zeros((len(x), len(self.plain)))
        for p in range(table.shape[1]):
            np.maximum(low, np.abs(table[:, p, None] - self.table[None, :, p]), out=low)
        order = np.argsort(low, axis=1, kind="stable")
        bound = np.take_along_axis(low, order, 1) - SLACK
        for r in range(len(self.plain)):
            rows = np.flatnonzero(bound[:, r] <= np.sqrt(best.astype(float)))
            if not len(rows):
                break
            j = order[rows, r]
            d = ((x[rows] - self.matrix[j]) ** 2).sum(1)
            looked += len(rows)
            number = self.plain[j]
            better = (d < best[rows]) | (d == best[rows]) & (number < found[rows])
            best[rows[better]], found[rows[better]] = d[better], number[better]
        for i in self.far:
            d = ((x.astype(object) - np.array(self.all[i], object)) ** 2).sum(1)
            better = np.array([e < b or e == b and i < f for e, b, f in zip(d.tolist(), best.tolist(), found.tolist(), strict=True)], bool)
            best[better], found[better] = d[better].astype(np.int64), i
        return found, best, looked

    def nearest_big(self, vector: list[int]) -> tuple[int, int]:
        d, i = min((square(vector, c), i) for i, c in enumerate(self.all))
        return i, d


def _assigned(batch: pa.RecordBatch, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """Of a batch of the pivot table: rows and vectors of plain size, their clusters and distances, and the big ones (row, vector, cluster, distance)."""
    v, big = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    rows = np.array([i for i, b in enumerate(v) if b is not None], np.int64)
    x = matrix([v[i] for i in rows])
    table = np.frombuffer(b"".join(batch.column(3).take(pa.array(rows)).to_pylist()), "<f8").reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))
    found, best, _ = centroids.nearest(x, table) if len(rows) else (np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
    odd = []
    for i, b in enumerate(big):
        if b is not None:
            vector = parsed(b)
            odd.append((i, vector, *centroids.nearest_big(vector)))
    return rows, x, found, best, odd


def clusters(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dimension: int = DIMENSION, pivots: int = PIVOTS) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids.

    Kept are vectors of ``dimension`` components, none null or non-finite; a component x becomes floor(scale * x).
    Centroids start as the kept vectors of the smallest SHA-256 of ``1:<vec_id>``: of rows that repeat an id the one
    of least components, a null id last. With fewer vectors than ``centroids`` there are as many centroids as rows;
    an empty table gives no rows. Repeated rows are vectors of their own. Components may be of any size: vectors
    beyond 2**24 are compared with all centroids in exact integers, and distances beyond a long are given as the
    largest long. Only ``vec_id`` and ``embedding`` are read, so further columns of any name don't matter.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kept = rows.mapInArrow(_kept(scale, dimension), "vec_id long, v binary, big string")
    first = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    starts = kept.orderBy(first.asc_nulls_last(), "vec_id", "v", "big").limit(centroids).collect()
    now = [read(r.v, r.big) for r in starts]
    some = kept.where("v is not null").select("v").orderBy(F.xxhash64("v"), "v").limit(PIVOT_SAMPLE).collect()
    fixed = far_apart(matrix([bytes(r.v) for r in some]), pivots) if some else np.zeros((0, dimension), np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(1).to_pylist()
            t: list = [None] * len(cells)
            at = [i for i, c in enumerate(cells) if c is not None]
            for i, d in zip(at, to_pivots(matrix([cells[i] for i in at]), fixed) if at else [], strict=True):
                t[i] = d.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t, pa.binary())], names=["vec_id", "v", "big", "t"])

    table = written(kept.mapInArrow(place, "vec_id long, v binary, big string, t binary"))
    for _ in range(rounds if now else 0):
        round_ = Centroids(now, fixed)

        def add(batch: pa.RecordBatch, sums: Sums, of: Centroids = round_) -> None:
            _, x, found, _, odd = _assigned(batch, of)
            for j in np.unique(found):
                sums.add(int(j), (found == j).sum(), x[found == j].sum(0))
            for _, vector, j, _ in odd:
                sums.add(j, 1, vector)

        now = moved(now, summed(table, add))
    last = Centroids(now, fixed)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            rows, _, found, best, odd = _assigned(batch, last)
            cluster[rows], distance[rows] = found, best
            for i, _, j, d in odd:
                cluster[i], distance[i] = j, min(d, LARGEST)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(final, "vec_id long, cluster int, distance long"), now


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``found`` with its distances summed by cluster and over all, and the digests of the centroids.

    The driver holds one number a cluster. Sums beyond a long are given as the largest long.
    """
    found = written(found)
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(j, min(t, LARGEST), digest[j]) for j, t in sums.items()]
    of = found.sparkSession.createDataFrame(rows, "_cluster int, cluster_inertia long, centroid_sha256 string")
    everything = F.lit(min(sum(sums.values()), LARGEST)).cast("long").alias("inertia")
    joined = found.join(F.broadcast(of), F.col("cluster") == F.col("_cluster"))
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", everything, "centroid_sha256")


def clusters_sql(centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dimension: int = DIMENSION) -> str:
    """The same rows in DuckDB SQL, by comparing every vector with every centroid."""
    near = "SELECT k.vec_id, k.v, arg_min(c.j, (list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) ** 2)), c.j)) AS j FROM kept k, {c} c GROUP BY k.vec_id, k.v"
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({scale} * x)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id) - 1 AS j, v FROM kept QUALIFY j < {centroids})",
    ]
    for r in range(rounds):
        parts += [
            f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})",
            f"s{r} AS (SELECT j, p, sum(v[p])::HUGEINT AS s, count(*) AS n FROM a{r}, range(1, {dimension} + 1) t(p) GROUP BY j, p)",
            f"m{r} AS (SELECT j, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY p) AS v FROM s{r} GROUP BY j)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (j))",
        ]
    parts += [
        f"last AS MATERIALIZED ({near.format(c=f'c{rounds}')})",
        f"d AS (SELECT l.vec_id, l.j, list_sum(list_transform(list_zip(l.v, c.v), lambda p: (p[1] - p[2]) ** 2))::BIGINT AS distance, sha256(array_to_string(c.v, ',')) AS h FROM last l JOIN c{rounds} c USING (j))",
    ]
    return f"""WITH {", ".join(parts)} SELECT vec_id, j::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM d"""
