"""Comparing and fusing the shots that cover a cell.

The rows of one cell are the shots covering it, at most the shots of one
page, so lists and windows per cell are short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..limits import GLARE_FLAG, GLARE_FLOOR, GLARE_TAU, SHARPNESS
from . import layers
from .grid import disk_offsets, smoothed

CELL = ["page_id", "y", "x"]
SHOT = ["page_id", "shot"]


def _over_cell() -> Window:
    return Window.partitionBy(*CELL)


def low_percentile(cells: DataFrame, value: str, q: float, name: str) -> DataFrame:
    """The lower ``q``-th percentile of the shots covering each cell, without interpolation."""
    values = F.array_sort(F.collect_list(value))
    per_cell = cells.groupBy(*CELL).agg(values.alias("_v"))
    return per_cell.select(*CELL, F.size("_v").alias("shots"), F.get("_v", F.floor(F.lit(q) / 100 * (F.size("_v") - 1)).cast("int")).alias(name))


def excess_over_darkest(cells: DataFrame, value: str, name: str = "excess") -> DataFrame:
    """How much brighter each shot is than the darkest shot covering the cell."""
    return cells.withColumn(name, F.col(value) - F.min(value).over(_over_cell()))


def excess_over_clean(cells: DataFrame, value: str, shadowed: str, name: str = "excess") -> DataFrame:
    """As ``excess_over_darkest``, against the darkest unshadowed shot where there is one."""
    clean = F.min(F.when(~F.col(shadowed), F.col(value))).over(_over_cell())
    return cells.withColumn(name, F.greatest(F.col(value) - F.coalesce(clean, F.min(value).over(_over_cell())), F.lit(0.0)))


def leave_one_out(cells: DataFrame, value: str, name: str = "reference") -> DataFrame:
    """What the other shots show: the other shot where exactly one other covers, else the lower median of all.

    Also ``others``, how many other shots cover the cell. The reference is null where none does.
    """
    w = _over_cell()
    count, total = F.count(F.lit(1)).over(w), F.sum(value).over(w)
    values = F.array_sort(F.collect_list(value).over(w))
    lower = F.get(values, F.floor((F.size(values) - 1) / 2).cast("int"))
    others = count - 1
    return cells.withColumn("others", others).withColumn(name, F.when(others == 1, total - F.col(value)).when(others > 1, lower))


def weights(cells: DataFrame, gw: int, gh: int, reach: int, halo: int, shadow: str | None = None, sharpness: float = SHARPNESS) -> DataFrame:
    """Each shot's weight on each cell it covers.

    ``cells`` has ``excess`` (0..1); the excess is widened by ``halo`` before it
    lowers the weight, the weight fades towards the shot's edge over ``reach``
    cells, and a shadow share (already widened) lowers it further.
    """
    offsets = disk_offsets(halo)

    def around(l: layers.Layers) -> dict:
        excess, a = l.column("excess"), np.full(np.prod(l.shape), -np.inf)
        np.fmax.at(a, l.at(), excess)
        wide = l.take(layers.disk_max(a.reshape(l.shape), offsets, -np.inf))
        return {"wide_excess": wide, "distance": l.take(layers.edge_distance(l.covered(), reach)), "_keep": wide > -np.inf}

    joined = layers.with_columns(layers.on_grid(cells, SHOT, gw, gh), SHOT, around, {"wide_excess": "double", "distance": "double"}, gw, gh)
    fade = F.least(F.greatest(F.col("distance") / reach, F.lit(1e-3)), F.lit(1.0))
    base = fade * F.exp(-F.greatest(F.col("wide_excess") - GLARE_FLOOR, F.lit(0.0)) / GLARE_TAU)
    if shadow is not None:
        base = base * (1 - F.col(shadow))
    return joined.withColumn("weight", F.pow(base, F.lit(sharpness)) + 1e-8)


def smoothed_shares(cells: DataFrame, sigma: float, gw: int, gh: int) -> DataFrame:
    """Weights as smoothed shares of the cell's total, so that shots hand over gradually."""
    share = cells.withColumn("_share", F.col("weight") / F.greatest(F.sum("weight").over(_over_cell()), F.lit(1e-30)))
    out = smoothed(share, SHOT, "_share", sigma, gw, gh, "_smooth")
    return out.withColumn("weight", F.col("_smooth") + 1e-8).drop("_share", "_smooth")


def fused(cells: DataFrame, weight: str, *values: str) -> DataFrame:
    """Weighted mean of each value on every covered cell: ``sum(w * v) / sum(w)``."""
    w = F.col(weight)
    total = F.sum(w)
    return cells.groupBy(*CELL).agg(*[F.when(total > 0, F.sum(w * F.col(v)) / total).otherwise(F.lit(0.0)).alias(v) for v in values])


def residual(cells: DataFrame, weight: str, glare: str) -> DataFrame:
    """The share of each fused cell that came from glared (or shadowed) light."""
    return fused(cells.withColumn("residual", F.col(glare)), weight, "residual")


def combined_glare(glare: Column, score: Column, excess: Column, weak: float, flag: float = GLARE_FLAG) -> Column:
    """A shot's own glare, or the comparison's where its own score is at least weakly positive."""
    compared = F.least(F.greatest(excess / flag, F.lit(0.0)), F.lit(1.0))
    return F.greatest(glare, F.when(score >= weak, compared).otherwise(F.lit(0.0)))


def page_fractions(cells: DataFrame, cells_on_page: int) -> DataFrame:
    """Per page: covered and uncovered share, share of the covered area one shot alone covers."""
    per_cell = cells.groupBy(*CELL).agg(F.count_distinct("shot").alias("shots"))
    covered = F.count(F.lit(1))
    return per_cell.groupBy("page_id").agg(
        (covered / cells_on_page).alias("covered"),
        (1 - covered / cells_on_page).alias("uncovered"),
        F.try_divide(F.count_if(F.col("shots") == 1), covered).alias("single"),
    )


def shot_shares(cells: DataFrame, value: str, threshold: float, name: str) -> DataFrame:
    """Per shot: the share of its covered area at or above ``threshold``."""
    return cells.groupBy(*SHOT).agg((F.count_if(F.col(value) >= threshold) / F.count(F.lit(1))).alias(name))


def tone_reference(cells: DataFrame, clip_at: int = 250, tolerance: float = 0.02) -> DataFrame:
    """The shot whose colours the others are matched to.

    Of the shots with (nearly) the fewest clipped cells, the one of middle
    mean brightness; ``cells`` has channels b, g, r. One row per page.
    """
    brightest = F.greatest("b", "g", "r")
    per_shot = cells.groupBy(*SHOT).agg(
        (F.count_if(brightest >= clip_at) / F.count(F.lit(1))).alias("clipped"),
        # Channel values are whole numbers, so the sum is exact whatever the order.
        (F.sum(F.col("b") + F.col("g") + F.col("r")) / (3 * F.count(F.lit(1)))).alias("bright"),
    )
    page = Window.partitionBy("page_id")  # one row per shot here
    ok = per_shot.withColumn("_least", F.min("clipped").over(page)).filter(F.col("clipped") <= F.col("_least") + tolerance)
    ranked = ok.withColumn("_r", F.row_number().over(page.orderBy("bright", "shot")) - 1).withColumn("_n", F.count(F.lit(1)).over(page))
    return ranked.filter(F.col("_r") == F.floor(F.col("_n") / 2)).select("page_id", "shot", "clipped", "bright")


def coverage_counted(cells: DataFrame) -> DataFrame:
    """``cells`` with ``shots``, how many shots cover the cell."""
    return cells.withColumn("shots", F.count(F.lit(1)).over(_over_cell()))
