"""Operator 9: near-duplicate vectors by PCA-ordered tiled comparison.

Vectors of one label are turned into their principal axes, largest variance first, and laid in tiles along the
first axis. Two tiles are compared by adding up the products of leading axes: what the rest can still add is at
most the product of both suffix norms (Cauchy-Schwarz), so a pair is dropped as soon as its cosine can't reach the
threshold, and the comparison of two tiles stops when no pair is left. Pairs that stay are decided on the vectors
as they came, in double precision. The axes only steer the work: any rotation gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, saved
from .linking import components

THRESHOLD = 0.93
#: Vectors of a tile, about; and the sample that the axes are taken from (those of the least hashes).
TILE, AXES_SAMPLE = 1024, 20_000
#: Width of a cell on the first axis: vectors that link lie at most two cells apart.
CELLS_APART = 2
#: Pairs are followed one by one once fewer than this share of a tile pair is left.
SPARSE = 0.02


def cell_width(threshold: float) -> float:
    """Unit vectors of cosine t lie sqrt(2 - 2t) apart, so no further apart on any axis."""
    return sqrt(max(2 - 2 * threshold, 1e-6)) / CELLS_APART * (1 + 1e-9)


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector as bytes of doubles; null where it can't be compared."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = None if v is None or None in v else np.array(v, "<f8")
            out.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
        yield batch.set_column(1, "v", pa.array(out, pa.binary()))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to between a half and one.

    Squares then neither overflow nor vanish; the rounding of products and sums of ordinary vectors stays the same.
    """
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def cosine(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, of scaled rows."""
    return (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1)))


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (columns, by falling variance) for each dimension found in a sample of ``AXES_SAMPLE`` vectors."""
    some = vectors.orderBy(F.xxhash64("v"), "rep").limit(AXES_SAMPLE).select("v").collect()
    by: dict[int, list[bytes]] = {}
    for r in some:
        by.setdefault(len(r.v) // 8, []).append(bytes(r.v))
    out = {}
    for d, rows in by.items():
        x = _unit(rows)
        out[d] = np.linalg.eigh(np.cov(x.T).reshape(d, d) if len(x) > 1 else np.eye(d))[1][:, ::-1].copy()
    return out


def _turned(rows: list[bytes], turn: dict[int, np.ndarray]) -> np.ndarray:
    x = _unit(rows)
    return x @ turn[x.shape[1]] if x.shape[1] in turn else x


def _compare(turn, threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Links of one pair of tiles: for each vector the copies that it links to, and the least vector that links tie it to here."""
        side = np.array(table.column("side").to_pylist())
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        raw = table.column("v").to_pylist()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(b)
        b = a if same else b
        none = pa.table({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        if not len(a) or not len(b):
            return none
        x = _turned([raw[i] for i in a], turn)
        y = x if same else _turned([raw[i] for i in b], turn)
        i, j = _candidates(x, y, threshold, same)
        if len(i):
            exact = [scaled(np.frombuffer(b"".join([raw[k] for k in side_]), "<f8").reshape(len(side_), -1)) for side_ in (a, b)]
            keep = []
            for s in range(0, len(i), 1 << 16):
                keep.append(cosine(exact[0][i[s : s + (1 << 16)]], exact[1][j[s : s + (1 << 16)]]) >= threshold)
            keep = np.concatenate(keep)
            i, j = i[keep], j[keep]
        if not len(i):
            return none
        p, q = a[i], b[j]
        links = np.zeros(len(side), np.int64)
        np.add.at(links, p, copies[q])
        np.add.at(links, q, copies[p])
        root = rep.copy()
        while True:
            low = np.minimum(root[p], root[q])
            before = root.copy()
            np.minimum.at(root, p, low)
            np.minimum.at(root, q, low)
            if (root == before).all():
                break
        hit = np.flatnonzero(links)
        return pa.table({"rep": rep[hit], "links": links[hit], "root": root[hit]})

    return run


def _candidates(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) whose cosine may reach the threshold, by leading axes first; ``same``: each pair once."""
    d, least = x.shape[1], threshold - 1e-9
    stops = sorted({*(k for k in (8, 16, 32, 64, 128, 256, 512) if k < d), d})
    tail = [np.sqrt(np.maximum(np.cumsum((z * z)[:, ::-1], 1)[:, ::-1], 0)) for z in (x, y)]
    rest = lambda z, k: tail[z][:, k] if k < d else np.zeros(len(tail[z]))
    total, start = np.zeros((len(x), len(y))), 0
    i = j = None
    for k in stops:
        if i is None:
            total += x[:, start:k] @ y[:, start:k].T
            alive = total + rest(0, k)[:, None] * rest(1, k)[None, :] >= least
            if same:
                alive = np.triu(alive, 1)
            n = np.count_nonzero(alive)
            if not n:
                return np.zeros(0, int), np.zeros(0, int)
            if k == d or n < SPARSE * alive.size:
                i, j = np.nonzero(alive)
                part = total[i, j]
        else:
            part = part + (x[i, start:k] * y[j, start:k]).sum(1)
            keep = part + rest(0, k)[i] * rest(1, k)[j] >= least
            i, j, part = i[keep], j[keep], part[keep]
        start = k
    return i, j


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; ``vec_id`` (long), ``embedding`` (array), ``label``.

    Vectors link if their labels are equal and not null and their cosine is at least ``threshold`` (above 0).
    Null and zero vectors and those with null or non-finite components link with nothing, nor do vectors of
    different length or with a null vec_id (their component is their own id). Finite components may be of any size:
    vectors are scaled by exact powers of two before they are multiplied, so that no square overflows or vanishes. Equal vectors of a label are one
    representative while compared; each counts as a link of the others. Repeated rows count like other copies.
    Tiles are compared in tasks of two tiles; a task returns one row a vector, however many pairs link.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    label = vectors.schema["label"].dataType.simpleString()
    packed = rows.mapInArrow(_valid, f"vec_id long, v binary, label {label}")
    key = F.when(F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.unhex(F.md5(F.concat(F.col("label").cast("string").cast("binary"), F.lit(b"\x00"), F.col("v")))))
    packed = saved(packed.withColumn("key", key))
    reps = saved(packed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("v").alias("v"), F.min("label").alias("label")))
    turn = vectors.sparkSession.sparkContext.broadcast(axes(reps))
    width = cell_width(threshold)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            cell, dim = np.zeros(len(raw), np.int32), np.array([len(v) // 8 for v in raw], np.int32)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                cell[at] = [floor(c / width) for c in _turned([raw[k] for k in at], turn.value)[:, 0]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dim)], names=[*batch.schema.names, "cell", "dim"])

    placed = saved(reps.select("rep", "copies", "v", "label").mapInArrow(cells, f"rep long, copies long, v binary, label {label}, cell int, dim int"))
    where = ["label", "dim", "cell"]
    counts = saved(placed.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")))
    tiled = saved(placed.join(checked_broadcast(counts), where).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).drop("tiles"))
    tiles = counts.select(*where, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    left = tiles.withColumn("beside", F.explode(F.sequence(F.col("cell"), F.col("cell") + CELLS_APART)))
    right = tiles.select(*[F.col(c).alias(f"r_{c}") for c in [*where, "tile"]])
    near = (F.col("label") == F.col("r_label")) & (F.col("dim") == F.col("r_dim")) & (F.col("beside") == F.col("r_cell"))
    once = F.struct("cell", "tile") <= F.struct(F.col("r_cell").alias("cell"), F.col("r_tile").alias("tile"))
    pairs = saved(left.join(right, near & once).drop("beside").withColumn("pair", F.xxhash64("label", "dim", "cell", "tile", "r_cell", "r_tile")))
    own = pairs.select(*where, "tile", "pair", F.lit(0).alias("side"))
    other = pairs.where("cell <> r_cell or tile <> r_tile").select("label", "dim", F.col("r_cell").alias("cell"), F.col("r_tile").alias("tile"), "pair", F.lit(1).alias("side"))
    sent = tiled.join(own.unionAll(other), [*where, "tile"]).select("pair", "side", "rep", "copies", "v")
    found = sent.groupBy("pair").applyInArrow(_by_pair(turn, threshold), "rep long, links long, root long")
    found = saved(found)
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    rooted = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = reps.select(F.col("key").alias("_key"), "rep", "copies").join(linked, "rep", "left").join(rooted, "rep", "left")
    known = saved(known.select("_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    out = packed.select("vec_id", "key").join(known, F.col("key") == F.col("_key"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _by_pair(turn, threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _compare(turn.value, threshold)(key, table)

    return run


def cosine_sql(threshold: float = THRESHOLD) -> str:
    """Links and components in DuckDB SQL, by all pairs of a label: for small tables."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda e: e / pow(2, least(1023, floor(log2(list_max(list_transform(embedding::DOUBLE[], lambda c: abs(c)))))))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= {threshold}),
reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
low AS (SELECT vec_id, min(other) AS low FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low.low, e.vec_id)) AS component_id, least(e.vec_id, coalesce(low.low, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN low USING (vec_id)"""
