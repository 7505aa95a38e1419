"""Glare labels from overlapping shots: 1 glare, 0 clean, null unknown."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..limits import GLARE_FLAG
from . import layers
from .fusion import CELL, SHOT
from .grid import local_max

AT = [*SHOT, "y", "x"]


def _fit(terms: list[np.ndarray], z: np.ndarray, use: np.ndarray, layer: np.ndarray, n: int) -> np.ndarray:
    """Least squares of each layer's cells ``use`` from moment sums; a rank-deficient system gets its least-norm solution."""
    total = lambda v: np.bincount(layer[use], v[use], n)
    a = np.stack([np.stack([total(p * q) for q in terms], -1) for p in terms], -2)
    return np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-10, hermitian=True), np.stack([total(p * z) for p in terms], -1))


def relit(cells: DataFrame, gw: int, gh: int, glare: float = GLARE_FLAG, step: int = 4, min_cells: int = 200) -> DataFrame:
    """``lum`` brought to ``ref`` by a smooth gain per shot, where ``sel`` holds enough cells to fit one.

    ``cells`` has ``lum``, ``ref`` and ``sel``. The gain is the exponential of
    a quadratic over the page, fitted on a sparse grid to the log ratio, leaving
    out what is much brighter than the reference, and once more without the
    outliers of the first fit.
    """
    use = F.col("sel") & (F.col("ref") > 0.1) & (F.col("lum") - F.col("ref") < glare) & (F.col("y") % step == 0) & (F.col("x") % step == 0)
    for k in SHOT:
        use = use & F.col(k).isNotNull()

    def lit(l: layers.Layers) -> dict:
        return {"_lit": _relit(l.layer, l.y / gh - 0.5, l.x / gw - 0.5, l.column("lum"), l.column("ref"), l.table["_use"].to_numpy(), len(l.starts), min_cells)}

    # The cells of one shot are bounded by its grid: both fits of a shot are one pass over them.
    rows = cells.withColumn("_use", F.coalesce(use, F.lit(False)))
    return layers.with_columns(rows, SHOT, lit, {"_lit": "double"}, gw, gh).withColumn("lum", F.col("_lit")).drop("_lit", "_use")


def _relit(layer: np.ndarray, y: np.ndarray, x: np.ndarray, lum: np.ndarray, ref: np.ndarray, use: np.ndarray, n: int, min_cells: int) -> np.ndarray:
    """``relit`` of the cells of ``n`` layers, fitted to the cells ``use``."""
    count = lambda some: np.bincount(layer[some], minlength=n)
    fits = count(use) >= max(min_cells, 1)
    use = use & fits[layer]
    terms = [np.ones(len(x)), x, y, x * x, x * y, y * y]
    z = np.log(np.where(use, (lum + 0.02) / (ref + 0.02), 1.0))
    curve = lambda c: sum(c[layer, i] * t for i, t in enumerate(terms))
    off = np.abs(z - curve(_fit(terms, z, use, layer, n)))
    kept = use & (off < np.maximum(3 * _medians(off, use, layer, n), 0.01)[layer])
    gain = np.exp(-np.clip(curve(_fit(terms, z, kept, layer, n)), -0.7, 0.7))
    return np.where(fits[layer], (lum + 0.02) * gain - 0.02, lum)


def _medians(v: np.ndarray, use: np.ndarray, layer: np.ndarray, n: int) -> np.ndarray:
    """The median of each layer's cells ``use``; 0 without any."""
    v, layer = v[use], layer[use]
    v, count = v[np.lexsort((v, layer))], np.bincount(layer, minlength=n)
    start, out = np.cumsum(count) - count, np.zeros(n)
    some = count > 0
    out[some] = 0.5 * v[(start + (count - 1) // 2)[some]] + 0.5 * v[(start + count // 2)[some]]
    return out


def _numbered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by ``keys``, the last one first, and the number of each row's group in that order."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new)
    return order, number


def _low_percentile(cell: np.ndarray, size: np.ndarray, lum: np.ndarray, q: float) -> np.ndarray:
    """``low_percentile`` of each of some cells; NaN without values."""
    n = np.bincount(cell[~np.isnan(lum)], minlength=len(size))
    low = (np.cumsum(size) - size) + np.floor(q / 100 * np.maximum(n - 1, 0)).astype(np.int64)
    return np.where(n > 0, lum[np.lexsort((lum, cell))][low], np.nan)


def _compared(l: layers.Layers, glare: float, percentile: float, min_shots: int, shift: int, rounds: int, step: int, min_cells: int) -> dict:
    """Luminance, reference, its highest nearby and whether enough shots cover it, for the cells of some pages."""
    pages, gh, gw = l.shape
    lum, none = l.column("lum").copy(), l.table["shot"].is_null().to_numpy()
    _, cell = _numbered(l.x, l.y, l.layer)
    size = np.bincount(cell)
    sel = size[cell] >= min_shots
    order, shot = _numbered(l.table["shot"].fill_null(0).to_numpy(), none, l.layer)
    ends = np.append(np.flatnonzero(np.diff(shot[order])) + 1, len(order))
    ref = _low_percentile(cell, size, lum, percentile)[cell]
    for _ in range(rounds):
        at = 0
        while at < len(order):  # some whole shots at a time
            stop = int(ends[min(max(np.searchsorted(ends, at + layers.BATCH_ROWS, "right") - 1, np.searchsorted(ends, at, "right")), len(ends) - 1)])
            some = order[at:stop]
            y, x, own, near = l.y[some], l.x[some], lum[some], ref[some]
            use = sel[some] & ~none[some] & (near > 0.1) & (own - near < glare) & (y % step == 0) & (x % step == 0)
            first = shot[some[0]]
            lum[some] = _relit(shot[some] - first, y / gh - 0.5, x / gw - 0.5, own, near, use, int(shot[some[-1]] - first) + 1, min_cells)
            at = stop
        ref = _low_percentile(cell, size, lum, percentile)[cell]
    inside = l.inside()
    place = ((l.layer * gh + l.y) * gw + l.x)[inside]
    high = np.full(pages * gh * gw, -np.inf)
    high[place] = np.where(np.isnan(ref[inside]), -np.inf, ref[inside])
    high = layers.box_max(high.reshape(l.shape), shift, -np.inf).reshape(-1)
    ref_high = np.full(len(lum), np.nan)
    ref_high[inside] = np.where(np.isinf(high[place]), np.nan, high[place])
    return {"_lum": lum, "_ref": ref, "_high": ref_high, "_sel": sel, "_keep": inside}


def overlap_labels(
    cells: DataFrame, gw: int, gh: int, glare: float = GLARE_FLAG, clean: float = 0.02, percentile: float = 25.0, min_shots: int = 2,
    shift: int = 3, relight: bool = True, step: int = 4, min_cells: int = 200,
) -> DataFrame:
    """Each shot's cells labelled by comparison with the shots covering them.

    ``cells`` has a smoothed luminance ``lum`` (0..1). A cell is glare only
    where it is brighter than the brightest reference within ``shift`` cells,
    since shots never line up exactly beside an edge.

    The shots of a page are compared and relit together, some whole pages at a time: its cells are shuffled once.
    """
    rows = cells.select(*AT, "lum").dropna(subset=CELL)
    kind = T.DoubleType() if relight else rows.schema["lum"].dataType
    compare = lambda l: _compared(l, glare, percentile, min_shots, shift, 2 if relight else 0, step, min_cells)
    c = layers.with_columns(rows, ["page_id"], compare, dict.fromkeys(("_lum", "_ref", "_high"), "double") | {"_sel": "boolean"}, gw, gh)
    # Clean wins where both hold, as the later of the two decisions.
    label = F.when(F.col("_sel") & (F.col("_lum") - F.col("_ref") <= clean), 0).when(F.col("_sel") & (F.col("_lum") - F.col("_high") >= glare), 1)
    return c.select(*AT, F.col("_lum").cast(kind).alias("lum"), F.col("_ref").cast(kind).alias("ref"), label.cast("int").alias("label"))


def cleaned_labels(labels: DataFrame, gw: int, gh: int, rim: int = 4) -> DataFrame:
    """Labels with the rim of each shot, and glare too thin to hold a 3 x 3 square, set to unknown."""

    def clear(l: layers.Layers) -> dict:
        inside = l.inside()
        for k in SHOT:
            inside &= l.table[k].is_valid().to_numpy()
        covered, glare, label, at = np.zeros(np.prod(l.shape), bool), np.zeros(np.prod(l.shape), bool), l.column("label")[inside], l.at()[inside]
        covered[at] = True
        glare[at[label == 1]] = True
        inner = layers.box_all(covered.reshape(l.shape), rim).reshape(-1)
        solid = layers.box_any(layers.box_all(glare.reshape(l.shape), 1), 1).reshape(-1)
        out = np.zeros(len(inside), bool)
        out[inside] = inner[at] & ((label != 1) | solid[at])
        return {"_clear": out}

    l = layers.with_columns(labels, SHOT, clear, {"_clear": "boolean"}, gw, gh)
    return l.withColumn("label", F.when(F.col("_clear"), F.col("label"))).drop("_clear")


def composition_glare(page: DataFrame, reference: DataFrame, gw: int, gh: int, glare: float = GLARE_FLAG, shift: int = 3, rim: int = 4, step: int = 4, min_cells: int = 200) -> DataFrame:
    """Glare of a composition against the page composed from every shot: cells (page_id, shot, y, x).

    ``page`` is (page_id, shot, y, x, lum), ``shot`` naming the composition;
    ``reference`` is (page_id, y, x, lum).
    """
    ref = reference.select(*CELL, F.col("lum").alias("ref"))
    both = page.join(ref, CELL).withColumn("sel", F.lit(True))
    lit = relit(both, gw, gh, glare, step, min_cells)
    high = local_max(ref, ["page_id"], "ref", shift, gw, gh, "ref_high")
    lab = lit.join(high, CELL).withColumn("label", F.when(F.col("lum") - F.col("ref_high") >= glare, 1).cast("int"))
    return cleaned_labels(lab, gw, gh, rim).filter("label = 1").select(*AT)


def training_samples(cells: DataFrame, glare_flag: float = GLARE_FLAG, clean: float = 0.02) -> DataFrame:
    """Feature rows by class: every third glare and every fifteenth clean cell of each shot.

    ``cells`` has ``excess`` and ``truth`` (share of true glare), feature
    columns and ``shots``. A cell one shot covers is judged by the truth,
    an overlapped one by the comparison.
    """
    from .catalog import strided

    one, both = F.col("shots") == 1, F.col("shots") >= 2
    pos = (one & (F.col("truth") > 0.5)) | (both & (F.col("excess") > glare_flag))
    neg = (one & (F.col("truth") < 0.01)) | (both & (F.col("excess") < clean))
    classed = cells.withColumn("label", F.when(pos, 1).when(neg, 0)).filter(F.col("label").isNotNull())
    return strided(classed, [*SHOT, "label"], ["y", "x"], F.when(F.col("label") == 1, 3).otherwise(15))
