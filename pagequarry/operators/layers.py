"""Whole layers of the grid (a page, or a page's shot) in one pass, many in one batch.

A layer is bounded by its grid (``GRID_MAX_SIDE``). Spark hashes the cells by layer once and sorts them; tasks then
hold a few ten thousand cells at a time, always whole layers, and work on arrays. So neighbours cost neither widened
rows nor joins, and a group of its own for each layer (milliseconds) is not needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import spread_groups

BATCH_ROWS = 1 << 16
DENSE_CELLS = 1 << 20  # cells of dense arrays worked on at once; at least one layer
_BOX_VALUES = 1 << 22  # values of neighbours held at once


class Layers:
    """The cells of some whole layers: columns as arrays, and dense arrays of shape (layer, y, x) of their grids."""

    def __init__(self, table: pa.Table, starts: np.ndarray, gw: int, gh: int):
        self.table, self.starts, self.shape = table, starts, (len(starts), gh, gw)
        self.layer = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        self.y, self.x = self.whole("y"), self.whole("x")

    def whole(self, name: str) -> np.ndarray:
        """Values as whole numbers, -1 for null: no place on a grid."""
        return self.table[name].fill_null(-1).to_numpy().astype(np.int64)

    def column(self, name: str) -> np.ndarray:
        """Values as doubles, NaN for null."""
        return self.table[name].cast(pa.float64()).to_numpy()

    def inside(self) -> np.ndarray:
        """Whether each cell lies on the grid."""
        return (self.y >= 0) & (self.y < self.shape[1]) & (self.x >= 0) & (self.x < self.shape[2])

    def at(self) -> np.ndarray:
        return (self.layer * self.shape[1] + self.y) * self.shape[2] + self.x

    def lay(self, values: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Sums of values on the grids; cells that are not there are 0."""
        return np.bincount(self.at() if at is None else at, values, np.prod(self.shape)).reshape(self.shape)

    def covered(self) -> np.ndarray:
        a = np.zeros(np.prod(self.shape), bool)
        a[self.at()] = True
        return a.reshape(self.shape)

    def take(self, a: np.ndarray) -> np.ndarray:
        return a.reshape(-1)[self.at()]


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each layer of a sorted table begins; nulls are equal."""
    changed = np.zeros(table.num_rows, bool)
    changed[0] = True
    for k in keys:
        code = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        changed[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(changed)


def on_grid(cells: DataFrame, keys: list[str], gw: int, gh: int) -> DataFrame:
    """The cells that lie on the grid of a layer; a null key names none."""
    return cells.filter(F.col("y").between(0, gh - 1) & F.col("x").between(0, gw - 1) & F.expr(" AND ".join(["true", *[f"`{k}` IS NOT NULL" for k in keys]])))


def on_layers(cells: DataFrame, keys: list[str], fn: Callable[[Layers], pa.Table], schema, gw: int, gh: int) -> DataFrame:
    """``fn`` over all cells, some whole layers a call."""
    some = max(1, DENSE_CELLS // (gw * gh))

    def done(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(starts[1:], table.num_rows)
        for i in range(0, len(starts), some):
            a, b = starts[i], ends[min(i + some, len(starts)) - 1]
            yield from fn(Layers(table.slice(a, b - a), starts[i : i + some] - a, gw, gh)).to_batches()

    return on_groups(cells, keys, done, schema)


def on_groups(rows: DataFrame, keys: list[str], done: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``done`` over all rows, some whole groups a call: the rows sorted by group, and where each group begins."""
    # By a hash of its own, as an exchange by the keys would give way to a join's below, which adaptive execution may undo.
    # It is made again for the order, as a column of hashes would be a good part of what is shuffled.
    at = F.xxhash64(*keys)
    rows = spread_groups(rows, [at]).withColumn("_at", at).sortWithinPartitions("_at", *keys).drop("_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, BATCH_ROWS
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < enough:
                continue
            table = pa.Table.from_batches(held)
            starts = _starts(table, keys)
            cut = starts[-1]  # the last group may go on in the next batch
            if cut:
                yield from done(table.slice(0, cut), starts[:-1])
            held, size = table.slice(cut).to_batches(), size - cut
            enough = max(BATCH_ROWS, 2 * size)
        if held:
            table = pa.Table.from_batches(held)
            yield from done(table, _starts(table, keys))

    return rows.mapInArrow(run, schema)


_TYPES = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}


def with_columns(cells: DataFrame, keys: list[str], fn: Callable[[Layers], dict], added: dict[str, str], gw: int, gh: int) -> DataFrame:
    """``cells`` with the columns ``added`` (name: type), which ``fn`` gives for each cell; NaN becomes null.

    Cells for which ``fn`` has ``_keep`` false go.
    """
    schema = cells.schema
    for name, kind in added.items():
        schema = schema.add(name, kind)

    def run(l: Layers) -> pa.Table:
        out, table = fn(l), l.table
        for name, kind in added.items():
            table = table.append_column(name, pa.array(out[name], _TYPES[kind], from_pandas=True))
        return table.filter(pa.array(out["_keep"])) if "_keep" in out else table

    return on_layers(cells, keys, run, schema, gw, gh)


def _shifts(r: int, size: int) -> Iterator[tuple[int, slice, slice]]:
    """Each shift of an axis up to ``r``, with where it comes from and where it goes."""
    for d in range(-min(r, size - 1), min(r, size - 1) + 1):
        yield d, slice(max(d, 0), size + min(d, 0)), slice(max(-d, 0), size - max(d, 0))


def _combined(a: np.ndarray, r: int, axis: int, how, start, weights: list[float] | None = None) -> np.ndarray:
    out = np.full(a.shape, start, a.dtype)
    for d, source, target in _shifts(r, a.shape[axis]):
        s, t = [slice(None)] * 3, [slice(None)] * 3
        s[axis], t[axis] = source, target
        part = a[tuple(s)]
        how(out[tuple(t)], part if weights is None else part * weights[d + r], out=out[tuple(t)])
    return out


def box_sum(a: np.ndarray, r: int) -> np.ndarray:
    return _combined(_combined(a, r, 2, np.add, 0), r, 1, np.add, 0)


def box_any(a: np.ndarray, r: int) -> np.ndarray:
    return _combined(_combined(a, r, 2, np.logical_or, False), r, 1, np.logical_or, False)


def box_all(a: np.ndarray, r: int) -> np.ndarray:
    """Whether all neighbours on the grid are set."""
    return _combined(_combined(a, r, 2, np.logical_and, True), r, 1, np.logical_and, True)


def box_max(a: np.ndarray, r: int, low) -> np.ndarray:
    return _combined(_combined(a, r, 2, np.maximum, low), r, 1, np.maximum, low)


def weighted_sum(a: np.ndarray, kernel: list[float]) -> np.ndarray:
    r = len(kernel) // 2
    return _combined(_combined(a, r, 2, np.add, 0, kernel), r, 1, np.add, 0, kernel)


def disk_max(a: np.ndarray, offsets: list[tuple[int, int]], low) -> np.ndarray:
    """The largest value within an ellipse given by its rows (dy, reach in x)."""
    out = np.full(a.shape, low, a.dtype)
    for w in sorted({w for _, w in offsets}):
        along = _combined(a, w, 2, np.maximum, low)
        for dy in (dy for dy, reach in offsets if reach == w and abs(dy) < a.shape[1]):
            s, t = slice(max(-dy, 0), a.shape[1] - max(dy, 0)), slice(max(dy, 0), a.shape[1] + min(dy, 0))
            np.maximum(out[:, t], along[:, s], out=out[:, t])
    return out


def edge_distance(mask: np.ndarray, reach: int) -> np.ndarray:
    """Distance of each set cell to the nearest one that is not set or off the grid, at most ``reach``."""
    _, h, w = mask.shape
    x, y = np.arange(w), np.arange(h)
    left = np.maximum.accumulate(np.where(mask, -1, x), axis=2)
    right = np.minimum.accumulate(np.where(mask, w, x)[:, :, ::-1], axis=2)[:, :, ::-1]
    along = np.minimum(np.minimum(x - left, right - x), reach) ** 2
    best = np.minimum(np.minimum(y + 1, h - y) ** 2, reach * reach)[None, :, None] + np.zeros_like(along)
    for d, source, target in _shifts(reach, h):
        np.minimum(best[:, target], along[:, source] + d * d, out=best[:, target])
    return np.sqrt(best.astype(float))


def box_median(q: np.ndarray, r: int, layer: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The upper median of the small whole numbers within ``r`` cells of the given places."""
    n, h, w = q.shape
    padded = np.full((n, h + 2 * r, w + 2 * r), np.iinfo(np.int16).max, np.int16)
    padded[:, r : r + h, r : r + w] = q
    flat, wide = padded.reshape(-1), w + 2 * r
    near = (np.arange(2 * r + 1)[:, None] * wide + np.arange(2 * r + 1)).reshape(-1)
    count = (np.minimum(y + r, h - 1) - np.maximum(y - r, 0) + 1) * (np.minimum(x + r, w - 1) - np.maximum(x - r, 0) + 1)
    first = (layer * (h + 2 * r) + y) * wide + x
    out, some = np.empty(len(y), np.int64), max(1, _BOX_VALUES // len(near))
    for i in range(0, len(y), some):
        values = np.sort(flat[first[i : i + some, None] + near], axis=1)
        out[i : i + some] = values[np.arange(len(values)), count[i : i + some] // 2]
    return out
