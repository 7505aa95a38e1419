"""Glare seen in one shot on its own: four features, a logistic score, grown areas."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import photometry as P
from ..limits import BACKGROUND_FRAC, GLARE_BIAS, GLARE_FLAG, GLARE_SEED, GLARE_WEAK
from . import layers
from .catalog import strided
from .fusion import SHOT, coverage_counted
from .grid import gaussian_weights, smoothed_cells
from .regions import in_areas

AT = [*SHOT, "y", "x"]


def coarse_factor(gw: int, gh: int) -> tuple[float, int]:
    """Window of the local background in cells, and how much coarser its grid is."""
    win = max(3.0, BACKGROUND_FRAC * max(gw, gh))
    return win, max(1, int(win // 15))


def background(cells: DataFrame, gw: int, gh: int, **values: tuple[str, float]) -> DataFrame:
    """Median of each value around each covered cell, over a window of a few percent of the page.

    ``name=(value, scale)``: taken on a coarser grid, on values rounded to steps
    of ``1 / scale``; coarse cells that are mostly not covered are first filled
    from the covered ones, so what lies outside the shot never leaks in. All
    values share one pass over the cells. A shot without coarse cells that are mostly covered has no background and goes.
    """

    def around(l: layers.Layers) -> dict:
        return background_cells(l, np.ones(l.table.num_rows, bool), gw, gh, {name: (l.column(v), scale) for name, (v, scale) in values.items()})

    return layers.with_columns(layers.on_grid(cells, SHOT, gw, gh), SHOT, around, dict.fromkeys(values, "double"), gw, gh)


def background_cells(l: layers.Layers, use: np.ndarray, gw: int, gh: int, values: dict[str, tuple[np.ndarray, float]]) -> dict:
    """``background`` of the cells ``use`` of some layers, and ``_keep``: the cells that have one."""
    win, k = coarse_factor(gw, gh)
    shape = (len(l.starts), -(-gh // k), -(-gw // k))
    _, ch, cw = shape
    at = (l.layer * ch + l.y // k) * cw + l.x // k
    total = lambda v: np.bincount(at[use], v[use], np.prod(shape)).reshape(shape)
    inside = total(np.ones(len(use))) > 0.5 * k * k
    kernel = gaussian_weights(sigma := max(1.0, win / k), max(1, round(3 * sigma)))
    mass = layers.weighted_sum(inside.astype(float), kernel)
    some = use & inside.any(axis=(1, 2))[l.layer]
    size = max(3, int(round(win / k)) | 1)
    if k == 1:
        layer, y, x = l.layer[some], l.y[some], l.x[some]
    else:
        layer, y, x = (i.reshape(-1) for i in np.indices(shape))
    out = {"_keep": some}
    for name, (v, scale) in values.items():
        known = ~np.isnan(v)
        count = total(known.astype(float))
        own = total(np.where(known, v, 0.0)) / np.maximum(count, 1)
        there = inside & (count > 0)
        near = layers.weighted_sum(np.where(there, own, 0.0), kernel) / np.maximum(mass, 1e-30)
        near = np.where((mass > 1e-3) & ((layers.weighted_sum(there.astype(float), kernel) > 0)), near, _middle(own, there)[:, None, None])
        filled = np.where(there, own, near)
        q = np.floor(np.clip(np.nan_to_num(filled * scale + 0.5, nan=0.0), 0.0, 255.0)).astype(np.int16)
        median = layers.box_median(q, size // 2, layer, y, x) / scale
        out[name] = np.full(len(v), np.nan)
        out[name][some] = median if k == 1 else _between(median.reshape(shape), l, some, gw, gh)
    return out


def _middle(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The median of each layer's values; NaN where a layer has none."""
    v = np.sort(np.where(there, values, np.inf).reshape(len(values), -1), axis=1)
    n, row = there.sum(axis=(1, 2)), np.arange(len(values))
    lower, upper = v[row, np.maximum(n - 1, 0) // 2], v[row, np.minimum(n // 2, v.shape[1] - 1)]
    return np.where(n > 0, 0.5 * lower + 0.5 * upper, np.nan)


def _between(coarse: np.ndarray, l: layers.Layers, some: np.ndarray, gw: int, gh: int) -> np.ndarray:
    """Coarse values back on the fine grid, between the four nearest coarse cells."""
    _, ch, cw = coarse.shape
    fy, fx = (l.y[some] + 0.5) * ch / gh - 0.5, (l.x[some] + 0.5) * cw / gw - 0.5
    out = np.zeros(len(fy))
    for a in (0, 1):
        for b in (0, 1):
            cy, cx = np.floor(fy).astype(np.int64) + a, np.floor(fx).astype(np.int64) + b
            out += (1 - np.abs(fy - cy)) * (1 - np.abs(fx - cx)) * coarse[l.layer[some], np.clip(cy, 0, ch - 1), np.clip(cx, 0, cw - 1)]
    return out


def features(cells: DataFrame, gw: int, gh: int, raw: tuple[str, str, str] = ("b", "g", "r")) -> DataFrame:
    """Veil, lost colour, lost texture and clipping of each covered cell.

    ``cells`` has tone-matched channels b, g, r; ``raw`` names the channels as
    the camera wrote them, for the clipping feature.
    """
    b, g, r = (F.col(c) for c in "bgr")
    lightness, _, _ = P.lab(b, g, r)
    c = cells.withColumn("_mn", P.darkest(b, g, r).cast("double")).withColumn("_ch", P.chroma(b, g, r)).withColumn("_l", lightness).withColumn("_cl", P.clipped_share(*[F.col(n) for n in raw]))
    kernel = gaussian_weights(1.5, 4)

    def around(l: layers.Layers) -> dict:
        light, seen = l.column("_l"), l.column("_cl")
        known = ~np.isnan(light)
        v = np.where(known, light, 0.0)
        n, total, squares = (l.take(layers.box_sum(l.lay(a), 2)) for a in (known.astype(float), v, v * v))
        mean = total / np.maximum(n, 1)
        texture = np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean * mean, 0.0))
        values = {"_mn0": (l.column("_mn"), 1.0), "_ch0": (l.column("_ch"), 1.0), "_tx0": (texture, 4.0)}
        return {"_tx": texture, "clip": smoothed_cells(l, seen, kernel)} | background_cells(l, known, gw, gh, values)

    added = dict.fromkeys(("_tx", "clip", "_mn0", "_ch0", "_tx0"), "double")
    c = layers.with_columns(layers.on_grid(c, SHOT, gw, gh), SHOT, around, added, gw, gh).drop("_l", "_cl")
    return (
        c.withColumn("veil", P.clamp01((F.col("_mn") - F.col("_mn0")) / 255))
        .withColumn("desat", P.clamp01(1 - (F.col("_ch") + 2) / (F.col("_ch0") + 2)))
        .withColumn("flat", P.clamp01(1 - (F.col("_tx") + 0.5) / (F.col("_tx0") + 0.5)))
        .withColumn("clip", P.clamp01(F.col("clip")))
        .drop("_mn", "_ch", "_tx", "_mn0", "_ch0", "_tx0")
    )


def scored(features: DataFrame, bias=GLARE_BIAS) -> DataFrame:
    return features.withColumn("score", P.glare_score(*[F.col(c) for c in ("veil", "desat", "flat", "clip")], bias=bias))


def glare_areas(scores: DataFrame, gw: int, gh: int, seed: float = GLARE_SEED, weak: float = GLARE_WEAK, min_seed: int = 3) -> DataFrame:
    """``scores`` with ``glare``: the score inside the areas grown from strong seeds, 0 elsewhere."""
    return in_areas(scores, SHOT, "score", seed, weak, min_seed, gw, gh, "_in").withColumn("glare", F.when(F.col("_in"), F.col("score")).otherwise(0.0)).drop("_in")


# Detectors by name: each takes covered cells and gives them back with a ``score``.
DETECTORS: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {
    "features": lambda cells, gw, gh: scored(features(cells, gw, gh)),
    # Scores computed elsewhere (a learned detector) arrive as a column.
    "net": lambda cells, gw, gh: cells.withColumn("score", F.col("net_score").cast("double")),
}


def detect(cells: DataFrame, gw: int, gh: int, detector: str = "features", **growing) -> DataFrame:
    if detector not in DETECTORS:
        raise ValueError(f"detector must be one of {', '.join(sorted(DETECTORS))}, got {detector!r}")
    return glare_areas(DETECTORS[detector](cells, gw, gh), gw, gh, **growing)


def adapted_bias(
    cells: DataFrame, bias: float = GLARE_BIAS, max_shift: float = 1.5, candidates: int = 61, clean_weight: float = 30.0,
    min_labels: int = 2000, min_glare: int = 200, glare: float = GLARE_FLAG, clean: float = 0.02, sample: int = 20_000,
) -> DataFrame:
    """Per page the bias that best separates glare from clean where shots overlap.

    ``cells`` has ``z`` (the score's argument without bias) and ``excess``.
    Pages with too few labels keep the default. Each class of a page is thinned
    to about ``sample`` cells by a fixed stride. Of the candidates the first
    with the least loss wins.
    """
    over = coverage_counted(cells).filter("shots >= 2")
    label = F.when(F.col("excess") > glare, 1).when(F.col("excess") < clean, 0)
    labels = over.withColumn("label", label).filter(F.col("label").isNotNull()).select("page_id", "shot", "y", "x", "label", "z")
    sizes = labels.groupBy("page_id").agg(F.count_if(F.col("label") == 1).alias("_g"), F.count_if(F.col("label") == 0).alias("_c"))
    enough = sizes.filter((F.col("_g") + F.col("_c") >= min_labels) & (F.col("_g") >= min_glare) & (F.col("_c") > 0))
    stride = F.greatest(F.lit(1), F.floor(F.when(F.col("label") == 1, F.col("_g")).otherwise(F.col("_c")) / sample))
    thin = strided(labels.join(enough, "page_id"), ["page_id", "label"], ["shot", "y", "x"], stride)
    step = 2 * max_shift / (candidates - 1)
    ids = F.explode(F.sequence(F.lit(0), F.lit(candidates - 1)))
    # Every labelled cell meets every candidate, but only the two means per (page, label, candidate) leave the map side.
    tried = thin.select("page_id", "label", "z", ids.alias("k")).withColumn("b", bias - max_shift + F.col("k") * step)
    m = F.when(F.col("label") == 1, -(F.col("b") + F.col("z"))).otherwise(F.col("b") + F.col("z"))
    soft = F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))
    loss = tried.groupBy("page_id", "k", "b").agg(F.avg(F.when(F.col("label") == 1, soft)).alias("_lg"), F.avg(F.when(F.col("label") == 0, soft)).alias("_lc"))
    best = loss.groupBy("page_id").agg(F.min_by("b", F.struct(F.round(F.col("_lg") + clean_weight * F.col("_lc"), 12), "k")).alias("_b"))
    pages = cells.select("page_id").distinct()
    return pages.join(best, "page_id", "left").select("page_id", F.coalesce("_b", F.lit(bias)).alias("bias"), F.col("_b").isNotNull().alias("adapted"))
