"""Regions of a page mask: where they are, why they are there, and which shots see them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..limits import MIN_REGION_AREA, MIN_SINGLE_AREA, RESIDUAL_THRESHOLD
from ..session import ensure_checkpoint_dir
from . import layers
from .components import grid_components, label_layers
from .grid import closed, opened, shrunk

# Fixed words, row by row.
LOCATIONS = [["top-left", "top", "top-right"], ["left", "centre", "right"], ["bottom-left", "bottom", "bottom-right"]]


def location_word(cx: Column, cy: Column) -> Column:
    """The word of the 3 x 3 place a point (page fractions) lies in."""
    words = F.array(*[F.lit(w) for row in LOCATIONS for w in row])
    third = lambda c: F.least(F.lit(2), F.floor(c * 3)).cast("int")
    return F.get(words, third(cy) * 3 + third(cx))


def region_cells(mask: DataFrame, keys: list[str], gw: int, gh: int, min_area: float) -> DataFrame:
    """Cells of the connected areas of the closed ``mask`` that are large enough, with ``component``.

    Written out once (a checkpoint), since every reader joins it several times.
    """
    cells = grid_components(closed(mask, keys, 1, gw, gh), keys)
    found = cells.filter(F.col("pixels") / (gw * gh) >= min_area).drop("pixels")
    ensure_checkpoint_dir(mask.sparkSession)
    return found.checkpoint()


def region_stats(cells: DataFrame, keys: list[str], gw: int, gh: int, page_w: int, page_h: int) -> DataFrame:
    """One row per region: box in fractions and pixels, area, place, edges touched, and its rank on the page."""
    s = cells.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("pixels"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"),
    )
    touch = [("top", F.col("y0") <= 1), ("right", F.col("x1") >= gw - 1), ("bottom", F.col("y1") >= gh - 1), ("left", F.col("x0") <= 1)]
    px = lambda c, full, grid: F.bround(F.col(c) * full / grid, 0).cast("int")
    # The regions of one page are bounded by its grid.
    rank = Window.partitionBy(*keys).orderBy(F.col("pixels").desc(), "y0", "x0", "component")
    return s.select(
        *keys, "component", "pixels",
        F.row_number().over(rank).alias("ord"),
        *[F.bround(F.col(c) / n, 4).alias(f"f{c}") for c, n in (("x0", gw), ("y0", gh), ("x1", gw), ("y1", gh))],
        px("x0", page_w, gw).alias("px0"), px("y0", page_h, gh).alias("py0"), px("x1", page_w, gw).alias("px1"), px("y1", page_h, gh).alias("py1"),
        F.bround(F.col("pixels") / (gw * gh), 4).alias("area"),
        location_word((F.col("cx") + 0.5) / gw, (F.col("cy") + 0.5) / gh).alias("location"),
        F.array_compact(F.array(*[F.when(t, F.lit(e)) for e, t in touch])).alias("edges"),
    )


def coverage_count(cells: DataFrame, keys: list[str]) -> DataFrame:
    """How many shots cover each cell: (keys, y, x, shots)."""
    return cells.groupBy(*keys, "y", "x").agg(F.count_distinct("shot").alias("shots"))


def cause_regions(
    residual: DataFrame, cells: DataFrame, keys: list[str], gw: int, gh: int, page_w: int, page_h: int, causes: tuple[str, str],
    threshold: float = RESIDUAL_THRESHOLD, min_area: float = MIN_REGION_AREA,
) -> DataFrame:
    """Regions of leftover glare or shadow with the shots covering each and why it stayed.

    ``residual`` is a map (keys, y, x, residual); ``cells`` the shots' covered
    cells. The first cause holds when one shot alone covers more than half.
    """
    found = region_cells(residual.filter(F.col("residual") >= threshold), keys, gw, gh, min_area)
    at = [*keys, "y", "x"]
    seen = found.join(coverage_count(cells, keys), at, "left").join(residual.select(*at, "residual"), at, "left")
    why = seen.groupBy(*keys, "component").agg(
        F.count_if(F.col("shots") == 1).alias("_single"), F.count(F.lit(1)).alias("_all"), F.avg(F.coalesce("residual", F.lit(0.0))).alias("_severity")
    )
    # At most the shots of one page: a short list.
    who = found.join(cells.select(*at, "shot"), at).groupBy(*keys, "component").agg(F.array_sort(F.collect_set("shot")).alias("shots"))
    stats = region_stats(found, keys, gw, gh, page_w, page_h).drop("edges")
    return (
        stats.join(why, [*keys, "component"])
        .join(who, [*keys, "component"], "left")
        .withColumn("shots", F.coalesce("shots", F.array().cast("array<int>")))
        .withColumn("cause", F.when(F.col("_single") > 0.5 * F.col("_all"), causes[0]).otherwise(causes[1]))
        .withColumn("severity", F.bround("_severity", 4))
        .drop("_single", "_all", "_severity")
    )


def glare_regions(residual, cells, keys, gw, gh, page_w, page_h, **kw) -> DataFrame:
    return cause_regions(residual, cells, keys, gw, gh, page_w, page_h, ("single_shot", "all_shots_glared"), **kw)


def shadow_regions(residual, cells, keys, gw, gh, page_w, page_h, **kw) -> DataFrame:
    return cause_regions(residual, cells, keys, gw, gh, page_w, page_h, ("single_shot", "all_shots_shadowed"), **kw)


def single_mask(cells: DataFrame, keys: list[str], gw: int, gh: int) -> DataFrame:
    """Cells exactly one shot covers, opened so that seams between shots go."""
    return opened(coverage_count(cells, keys).filter("shots = 1"), keys, 1, gw, gh)


def single_regions(
    cells: DataFrame, keys: list[str], gw: int, gh: int, page_w: int, page_h: int, residual: DataFrame | None = None,
    threshold: float = RESIDUAL_THRESHOLD, min_area: float = MIN_SINGLE_AREA,
) -> DataFrame:
    """Regions one shot alone covers, with that shot and the share of glare seen (null when nobody looked)."""
    found = region_cells(single_mask(cells, keys, gw, gh), keys, gw, gh, min_area)
    at = [*keys, "y", "x"]
    overlap = found.join(cells.select(*at, "shot"), at).groupBy(*keys, "component", "shot").agg(F.count(F.lit(1)).alias("_n"))
    owner = overlap.groupBy(*keys, "component").agg(F.max_by("shot", F.struct("_n", (-F.col("shot")).alias("_first"))).alias("shot"))
    out = region_stats(found, keys, gw, gh, page_w, page_h).join(owner, [*keys, "component"], "left")
    if residual is None:
        return out.withColumn("glare_seen", F.lit(None).cast("double"))
    hot = residual.filter(F.col("residual") >= threshold).select(*at, F.lit(1).alias("_hot"))
    seen = found.join(hot, at, "left").groupBy(*keys, "component").agg(F.bround(F.count("_hot") / F.count(F.lit(1)), 4).alias("glare_seen"))
    return out.join(seen, [*keys, "component"])


def uncovered_mask(coverage: DataFrame, keys: list[str], factor: int, gw: int, gh: int, pages: DataFrame) -> DataFrame:
    """Coarse cells of which less than half is covered; ``coverage`` is the fine mask, ``gw`` x ``gh`` its grid."""
    from .grid import dense

    cover = shrunk(coverage, keys, factor, gw, gh, share=F.lit(1.0))
    cw, ch = -(-gw // factor), -(-gh // factor)
    return dense(pages.select(*keys).distinct(), cw, ch).join(cover.filter(F.col("share") >= 0.5), [*keys, "y", "x"], "left_anti")


def _seeded(l: layers.Layers, seed: np.ndarray, size: int) -> np.ndarray:
    """Of the ``seed`` cells those that a square of ``size`` cells holds."""
    if size <= 1:
        return seed
    if size % 2 == 0:
        raise ValueError("size must be odd")
    inside = seed & (l.y >= 0) & (l.y < l.shape[1]) & (l.x >= 0) & (l.x < l.shape[2])
    mask = np.zeros(np.prod(l.shape), bool)
    at = l.at()
    mask[at[inside]] = True
    wide = layers.box_any(layers.box_all(mask.reshape(l.shape), size // 2), size // 2).reshape(-1)
    inside[inside] = wide[at[inside]]
    return inside


def in_areas(score: DataFrame, keys: list[str], value: str, seed: float, weak: float, min_seed: int, gw: int, gh: int, name: str) -> DataFrame:
    """``score`` with ``name``: whether the cell is in a weak area that holds a wide enough seed."""

    def areas(l: layers.Layers) -> dict:
        v = l.column(value)
        set_ = v >= weak
        held = np.zeros(len(v), bool)
        held[set_] = label_layers(l.layer[set_], l.y[set_], l.x[set_], _seeded(l, v >= seed, min_seed)[set_])[2]
        return {name: held}

    placed = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, "y", "x"]))
    found = layers.with_columns(score.filter(placed), keys, areas, {name: "boolean"}, gw, gh)
    return found.unionByName(score.filter(~placed).withColumn(name, F.lit(False)))


def hysteresis(score: DataFrame, keys: list[str], value: str, seed: float, weak: float, min_seed: int, gw: int, gh: int) -> DataFrame:
    """Cells of the weak areas that hold a wide enough seed."""
    at = [*keys, "y", "x"]
    return in_areas(score.select(*at, value), keys, value, seed, weak, min_seed, gw, gh, "_in").filter("_in").select(*at).distinct()


def grown(seed_map: DataFrame, grow_map: DataFrame, keys: list[str], seed: float, weak: float, min_seed: int, min_area: float, gw: int, gh: int) -> DataFrame:
    """Areas of ``grow >= weak`` (or seed) holding a wide enough seed and at least ``min_area`` of the grid.

    Both maps have ``value``; the result carries the larger of the two.
    """
    at = [*keys, "y", "x"]
    both = seed_map.select(*at, F.col("value").alias("_seed"), F.lit(None).alias("_grow")).unionByName(grow_map.select(*at, F.lit(None).alias("_seed"), F.col("value").alias("_grow")))
    return grown_from(both, keys, "_seed", "_grow", seed, weak, min_seed, min_area, gw, gh)


def grown_from(cells: DataFrame, keys: list[str], seed_value: str, grow_value: str, seed: float, weak: float, min_seed: int, min_area: float, gw: int, gh: int) -> DataFrame:
    """As ``grown``, with both maps' values in one table; a null is a cell that a map does not have."""
    at = [*keys, "y", "x"]
    value = F.greatest(F.col(seed_value), F.col(grow_value)).cast("double").alias("value")
    some = cells.select(*at, F.col(seed_value).alias("_s"), F.col(grow_value).alias("_g"), value).dropna(subset=at)

    def areas(l: layers.Layers) -> dict:
        s, g = l.column("_s"), l.column("_g")
        seeds = _seeded(l, s >= seed, min_seed)
        set_ = (g >= weak) | seeds
        keep = np.zeros(len(s), bool)
        _, pixels, held = label_layers(l.layer[set_], l.y[set_], l.x[set_], seeds[set_])
        keep[set_] = held & (pixels >= min_area * gw * gh)
        _, which = np.unique((l.layer << 32) + (l.y << 16) + l.x, return_inverse=True)
        v = np.full(which.max() + 1, -np.inf)
        np.fmax.at(v, which, l.column("value"))
        place = np.full(len(v), -1)
        place[which[keep]] = np.flatnonzero(keep)  # a repeated cell counts once
        once = np.zeros(len(s), bool)
        once[place[place >= 0]] = True
        return {"_best": v[which], "_keep": once}

    return layers.with_columns(some, keys, areas, {"_best": "double"}, gw, gh).select(*at, F.col("_best").alias("value"))
