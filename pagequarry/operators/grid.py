"""Operators on the page grid.

A *mask* is a table of the cells that are set, a *map* a table of cells with a
value; both carry ``keys`` (for instance page and shot) with integer ``y`` and
``x``. Cells that are not in the table are not set. The grid is at most
``GRID_MAX_SIDE`` cells on its long side, so a row or a column of one key is at
most that many rows: windows here run over one row or one column of one key,
never over a whole page. Cells outside the grid do not count in any operator.

Neighbourhood operators first hash the cells by ``keys`` alone (a key's cells
are bounded by its grid). Every window and grouping that follows holds those
keys, so the widened rows are combined where they are and never shuffled.
Sums, means and distances work on whole layers as arrays (``layers``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..limits import GRID_MAX_SIDE
from . import layers
from .ordered import spread_groups

_BITS = 62  # cells of a row kept in one whole number


def _lit(v: int | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def checked(cells: DataFrame, gw: int | Column, gh: int | Column) -> DataFrame:
    """``cells`` with an error raised for any cell off its grid or a grid over the size limit."""
    w, h = _lit(gw), _lit(gh)
    inside = (F.col("x") >= 0) & (F.col("x") < w) & (F.col("y") >= 0) & (F.col("y") < h) & (F.greatest(w, h) <= GRID_MAX_SIDE)
    return cells.withColumn("x", F.when(inside, F.col("x")).otherwise(F.raise_error(F.lit("cell off the grid")).cast("int")))


def _line(keys: list[str], along: str) -> Window:
    across = "y" if along == "x" else "x"
    return Window.partitionBy(*keys, across).orderBy(along)


def _spread(cells: DataFrame, along: str, r: int, size: Column) -> DataFrame:
    at = F.sequence(F.greatest(F.col(along) - r, F.lit(0)), F.least(F.col(along) + r, size - 1))
    return cells.withColumn(along, F.explode(at))


def _dilate(mask: DataFrame, keys: list[str], r: int, gw, gh) -> DataFrame:
    m = _spread(mask.select(*keys, "y", "x"), "x", r, _lit(gw)).distinct()
    return _spread(m, "y", r, _lit(gh)).distinct()


def _erode(mask: DataFrame, keys: list[str], r: int, gw, gh) -> DataFrame:
    m = mask.select(*keys, "y", "x").distinct()
    for along, size in (("x", _lit(gw)), ("y", _lit(gh))):
        here = F.col(along)
        full = F.least(here + r, size - 1) - F.greatest(here - r, F.lit(0)) + 1
        near = F.count(F.lit(1)).over(_line(keys, along).rangeBetween(-r, r))
        m = m.withColumn("_near", near).filter(F.col("_near") == full).drop("_near")
    return m


def dilate(mask: DataFrame, keys: list[str], r: int, gw: int | Column, gh: int | Column) -> DataFrame:
    """Every cell within ``r`` cells (a square) of a set cell; one direction after the other."""
    return _dilate(spread_groups(mask, keys), keys, r, gw, gh)


def erode(mask: DataFrame, keys: list[str], r: int, gw: int | Column, gh: int | Column) -> DataFrame:
    """Set cells all of whose neighbours within ``r`` cells on the grid are set."""
    return _erode(spread_groups(mask, keys), keys, r, gw, gh)


def opened(mask: DataFrame, keys: list[str], r: int, gw, gh) -> DataFrame:
    return _dilate(_erode(spread_groups(mask, keys), keys, r, gw, gh), keys, r, gw, gh)


def closed(mask: DataFrame, keys: list[str], r: int, gw, gh) -> DataFrame:
    return _erode(_dilate(spread_groups(mask, keys), keys, r, gw, gh), keys, r, gw, gh)


def opened_by(mask: DataFrame, keys: list[str], size: int, gw, gh) -> DataFrame:
    """Opening by a square of ``size`` cells; an odd size only, as every caller uses."""
    if size <= 1:
        return mask.select(*keys, "y", "x").distinct()
    if size % 2 == 0:
        raise ValueError("size must be odd")
    return opened(mask, keys, size // 2, gw, gh)


def local_max(cells: DataFrame, keys: list[str], value: str, r: int, gw, gh, name: str) -> DataFrame:
    """The largest value within ``r`` cells (a square), on every grid cell some value reaches."""
    m = spread_groups(cells.select(*keys, "y", "x", F.col(value).alias(name)), keys)
    m = _spread(m, "x", r, _lit(gw)).groupBy(*keys, "y", "x").agg(F.max(name).alias(name))
    return _spread(m, "y", r, _lit(gh)).groupBy(*keys, "y", "x").agg(F.max(name).alias(name))


def disk_offsets(r: int) -> list[tuple[int, int]]:
    """Half-widths of an elliptical kernel of radius ``r``: (dy, reach in x) for each row."""
    out = []
    for dy in range(-r, r + 1):
        out.append((dy, int(round((r * r - dy * dy) ** 0.5))))
    return out


def local_max_disk(cells: DataFrame, keys: list[str], value: str, r: int, gw: int, gh: int, name: str) -> DataFrame:
    """The largest value within an ellipse of radius ``r``, on every grid cell some value reaches."""
    offsets = disk_offsets(r)
    some = layers.on_grid(cells, [], gw, gh).filter(F.col(value).isNotNull()).select(*keys, "y", "x", F.col(value).alias(name))
    whole = isinstance(some.schema[name].dataType, T.IntegralType)
    types = {n: to_arrow_type(some.schema[n].dataType) for n in ("y", "x", name)}

    def reached(l: layers.Layers) -> pa.Table:
        low = np.iinfo(np.int64).min if whole else -np.inf
        a = np.full(np.prod(l.shape), low, np.int64 if whole else float)
        np.maximum.at(a, l.at(), l.whole(name) if whole else l.column(name))
        top = layers.disk_max(a.reshape(l.shape), offsets, low)
        layer, y, x = np.nonzero(top != low)
        named = {k: l.table[k].take(pa.array(l.starts[layer])) for k in keys}
        return pa.table(named | {n: pa.array(v).cast(types[n]) for n, v in (("y", y), ("x", x), (name, top[layer, y, x]))})

    return layers.on_layers(some, keys, reached, some.schema, gw, gh)


def local_max_disk_at(cells: DataFrame, places: DataFrame, keys: list[str], value: str, r: int, gw: int, gh: int, name: str) -> DataFrame:
    """``local_max_disk`` as doubles, on those ``places`` only that some value reaches."""
    offsets, at = disk_offsets(r), [*keys, "y", "x"]
    values = layers.on_grid(cells, keys, gw, gh).select(*at, F.col(value).cast("double").alias("_v"), F.lit(False).alias("_place"))
    both = values.unionByName(layers.on_grid(places, keys, gw, gh).select(*at, F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_place")))

    def reached(l: layers.Layers) -> dict:
        a = np.full(np.prod(l.shape), -np.inf)
        np.fmax.at(a, l.at(), l.column("_v"))
        top = l.take(layers.disk_max(a.reshape(l.shape), offsets, -np.inf))
        return {name: top, "_keep": l.table["_place"].to_numpy() & (top > -np.inf)}

    return layers.with_columns(both, keys, reached, {name: "double"}, gw, gh).select(*at, name)


def box_sums(cells: DataFrame, keys: list[str], r: int, gw: int, gh: int, **sums: tuple[str, ...]) -> DataFrame:
    """``cells`` with sums over the box of radius ``r`` around each: ``name=columns`` sums the product of some columns.

    Without columns it counts cells. Null values count as 0.
    """

    def near(l: layers.Layers) -> dict:
        column = {c: np.nan_to_num(l.column(c), nan=0.0) for c in {c for cols in sums.values() for c in cols}}
        product = lambda cols: np.prod([column[c] for c in cols], axis=0) if cols else np.ones(l.table.num_rows)
        return {n: l.take(layers.box_sum(l.lay(product(cols)), r)) for n, cols in sums.items()}

    return layers.with_columns(layers.on_grid(cells, keys, gw, gh), keys, near, dict.fromkeys(sums, "double"), gw, gh)


def dense(pages: DataFrame, gw: int | Column, gh: int | Column) -> DataFrame:
    """Every cell of every key's grid."""
    return pages.withColumn("y", F.explode(F.sequence(F.lit(0), _lit(gh) - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), _lit(gw) - 1)))


def on_dense(cells: DataFrame, keys: list[str], gw, gh) -> DataFrame:
    """``cells`` laid on every cell of the grid of each key it has; values null where there was no cell."""
    return dense(cells.select(*keys).distinct(), gw, gh).join(cells, [*keys, "y", "x"], "left")


def box_mean(cells: DataFrame, keys: list[str], value: str, r: int, gw: int, gh: int) -> DataFrame:
    """Mean and deviation of ``value`` over a box, counting cells of ``cells`` only."""
    some = cells.filter(F.col(value).isNotNull()).select(*keys, "y", "x", value)
    sums = box_sums(some, keys, r, gw, gh, _n=(), _s=(value,), _q=(value, value))
    mean = F.try_divide("_s", "_n")
    return sums.select(
        *keys, "y", "x", value, F.col("_n").cast("bigint").alias("cells"), mean.alias("mean"), F.sqrt(F.greatest(F.try_divide("_q", "_n") - mean * mean, F.lit(0.0))).alias("deviation")
    )


def gaussian_weights(sigma: float, reach: int) -> list[float]:
    import math

    w = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    s = sum(w)
    return [x / s for x in w]


def smoothed(cells: DataFrame, keys: list[str], value: str, sigma: float, gw: int, gh: int, name: str, reach: int | None = None) -> DataFrame:
    """Gaussian mean of ``value`` over the cells of ``cells``, normalised by the kernel mass on them."""
    kernel = gaussian_weights(sigma, max(1, round(3 * sigma)) if reach is None else reach)
    mean = lambda l: {name: smoothed_cells(l, l.column(value), kernel)}
    return layers.with_columns(layers.on_grid(cells, keys, gw, gh), keys, mean, {name: "double"}, gw, gh)


def smoothed_cells(l: layers.Layers, v: np.ndarray, kernel: list[float]) -> np.ndarray:
    """``smoothed`` of some layers: nulls (NaN) add mass only, and what they alone reach is null."""
    null = np.isnan(v)
    total, mass = (l.take(layers.weighted_sum(l.lay(c), kernel)) for c in (np.where(null, 0.0, v), np.ones(len(v))))
    out = total / np.maximum(mass, 1e-6)
    if null.any():
        out[l.take(layers.weighted_sum(l.lay((~null).astype(float)), kernel)) == 0] = np.nan
    return out


def shrunk(cells: DataFrame, keys: list[str], factor: int, gw: int, gh: int, **cols: Column) -> DataFrame:
    """Area averages on a grid ``factor`` times coarser; a cell that is not in the table counts as 0."""
    y, x = F.floor(F.col("y") / factor).cast("int"), F.floor(F.col("x") / factor).cast("int")
    sums = cells.groupBy(*keys, y.alias("y"), x.alias("x")).agg(*[F.sum(c).alias(n) for n, c in cols.items()])
    high = F.least(F.lit(factor), F.lit(gh) - F.col("y") * factor)
    wide = F.least(F.lit(factor), F.lit(gw) - F.col("x") * factor)
    return sums.select(*keys, "y", "x", *[(F.col(n) / (high * wide)).alias(n) for n in cols])


def resized(cells: DataFrame, keys: list[str], nw: int, nh: int, gw: int, gh: int, **cols: Column) -> DataFrame:
    """Area averages on a grid of ``nw`` x ``nh`` cells, whatever the factor; a cell that is not in the table counts as 0.

    A cell is shared out by the area it has in common with each coarse cell, along x and then along y. Shares are whole
    numbers of 1/gw and 1/gh of a coarse cell.
    """
    m = cells.select(*keys, "y", "x", *[c.alias(n) for n, c in cols.items()])
    for along, fine, coarse in (("x", gw, nw), ("y", gh, nh)):
        other = "y" if along == "x" else "x"
        low, high = F.col(along) * coarse, (F.col(along) + 1) * coarse
        part = F.sequence(F.floor(low / fine).cast("int"), F.floor((high - 1) / fine).cast("int"))
        m = m.withColumn("_i", F.explode(part))
        share = F.least(high, (F.col("_i") + 1) * fine) - F.greatest(low, F.col("_i") * fine)
        m = m.groupBy(*keys, other, F.col("_i").alias(along)).agg(*[F.sum(F.col(n) * share).alias(n) for n in cols])
    return m.select(*keys, "y", "x", *[(F.col(n) / (gw * gh)).alias(n) for n in cols])


def shrunk_labels(cells: DataFrame, keys: list[str], factor: int, gw: int, gh: int, glare: float = 0.5, clean: float = 0.75) -> DataFrame:
    """Labels on a grid ``factor`` times coarser: 1 where at least ``glare`` of the area is glare, else 0 where at least ``clean`` is clean, else null.

    ``cells`` has ``label`` (1, 0 or null for unknown); what is not in the table is unknown.
    """
    area = shrunk(cells, keys, factor, gw, gh, _glare=(F.coalesce("label", F.lit(-1)) == 1).cast("int"), _clean=(F.coalesce("label", F.lit(-1)) == 0).cast("int"))
    return area.withColumn("label", F.when(F.col("_glare") >= glare, 1).when(F.col("_clean") >= clean, 0)).drop("_glare", "_clean")


def feather(mask: DataFrame, keys: list[str], reach: int, gw: int, gh: int) -> DataFrame:
    """Distance of each set cell to the nearest cell that is not set, at most ``reach``.

    The border around the grid counts as not set.
    """
    cells = layers.on_grid(mask.select(*keys, "y", "x"), keys, gw, gh)
    return layers.with_columns(cells, keys, lambda l: {"distance": l.take(layers.edge_distance(l.covered(), reach))}, {"distance": "double"}, gw, gh)


def box_fill(boxes: DataFrame, gw: int | Column, gh: int | Column, once: bool = False) -> DataFrame:
    """Cells of boxes given in page fractions (x0, y0, x1, y1): floor to ceiling on the grid.

    With ``once``, boxes of equal other columns are filled together on a grid of fixed size: each cell comes once.
    """
    w, h = _lit(gw), _lit(gh)
    x0, x1 = F.greatest(F.floor(F.col("x0") * w), F.lit(0)).cast("int"), F.least(F.ceil(F.col("x1") * w), w).cast("int") - 1
    y0, y1 = F.greatest(F.floor(F.col("y0") * h), F.lit(0)).cast("int"), F.least(F.ceil(F.col("y1") * h), h).cast("int") - 1
    xs, ys = F.sequence(x0, x1), F.sequence(y0, y1)
    some = (F.ceil(F.col("x1") * w) > F.floor(F.col("x0") * w)) & (F.ceil(F.col("y1") * h) > F.floor(F.col("y0") * h))
    keep = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")]
    if once:
        # A row of a grid is a few words of bits, which combine before the shuffle.
        rows = boxes.filter(some & (x0 <= x1) & (y0 <= y1)).select(*keep, F.explode(ys).alias("y"), x0.alias("_x0"), x1.alias("_x1"))
        one = isinstance(gw, int) and gw <= _BITS
        word = F.lit(0) if one else F.explode(F.sequence(F.floor(F.col("_x0") / _BITS).cast("int"), F.floor(F.col("_x1") / _BITS).cast("int")))
        rows = rows.withColumn("_w", word).withColumn("_lo", F.greatest(F.col("_x0") - F.col("_w") * _BITS, F.lit(0))).withColumn("_hi", F.least(F.col("_x1") - F.col("_w") * _BITS, F.lit(_BITS - 1)))
        words = rows.groupBy(*keep, "y", "_w").agg(F.expr("bit_or(shiftleft(1L, _hi + 1) - shiftleft(1L, _lo))").alias("_bits"))
        bit = F.explode(F.expr(f"filter(sequence(0, {_BITS - 1}), b -> shiftright(_bits, b) & 1L = 1L)"))
        return words.select(*keep, "y", "_w", bit.alias("_x")).select(*keep, "y", (F.col("_w") * _BITS + F.col("_x")).alias("x"))
    return boxes.filter(some).select(*keep, F.explode(ys).alias("y"), xs.alias("_xs")).select(*keep, "y", F.explode("_xs").alias("x"))


def row_runs(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of neighbouring set cells along each row: (keys, y, x0, x1)."""
    return cells_with_run(mask, keys).groupBy(*keys, "y", "x0").agg(F.max("x").alias("x1"))


def cells_with_run(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Set cells with the first cell ``x0`` of the row run they belong to."""
    cells = mask.select(*keys, "y", "x").distinct()
    row = Window.partitionBy(*keys, "y").orderBy("x")
    island = cells.withColumn("_i", F.col("x") - F.row_number().over(row))
    return island.withColumn("x0", F.min("x").over(Window.partitionBy(*keys, "y", "_i"))).drop("_i")


def run_adjacency(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of runs in neighbouring rows that touch, corners included."""
    lower = runs.select(*keys, (F.col("y") - 1).alias("y"), F.col("x0").alias("below_x0"), F.col("x1").alias("below_x1"))
    joined = runs.join(lower, [*keys, "y"])
    return joined.filter((F.col("x0") <= F.col("below_x1") + 1) & (F.col("x1") >= F.col("below_x0") - 1))
