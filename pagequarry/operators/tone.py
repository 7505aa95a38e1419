"""Bringing the shots of a page to one exposure: gains and tone curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import layers
from .fusion import CELL, SHOT
from .grid import gaussian_weights
from .ordered import spread_groups

CHANNELS = ("b", "g", "r")
BINS, LOW, HIGH = 280, 0.25, 4.0
_CURVES = 500  # curves written at once


def exposure_gains(cells: DataFrame, reference: DataFrame, rounds: int = 3, min_cells: int = 500, bright: int = 235) -> DataFrame:
    """Gain per shot and channel that brings it to the others: (page_id, shot, gains[b, g, r]).

    ``reference`` is (page_id, shot): that shot stays at 1. Shots are taken in
    turn, each against the others at their current gains, for ``rounds`` rounds,
    which makes a page one sequential fit. A page is bounded by its grid and its
    shots, so each page is one grouped task over its cells, whatever the number
    of pages, and there is one job in all.
    """
    ref = reference.select("page_id", F.col("shot").alias("_ref"))
    rows = cells.select("page_id", "shot", "y", "x", *CHANNELS).join(ref, "page_id")
    schema = f"page_id {cells.schema['page_id'].dataType.simpleString()}, shot {cells.schema['shot'].dataType.simpleString()}, gains array<double>"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        shots = np.sort(pdf["shot"].unique())
        value = _planes(pdf, shots, bright)
        gains = np.ones((len(shots), len(CHANNELS)))
        for _ in range(rounds):
            for k, shot in enumerate(shots):
                if shot != pdf["_ref"].iloc[0]:
                    gains[k] = _matched(value, gains, k, min_cells, bright)
        return pd.DataFrame({"page_id": pdf["page_id"].iloc[0], "shot": shots, "gains": list(gains)})

    return spread_groups(rows, ["page_id"]).groupBy("page_id").applyInPandas(solve, schema)


def _planes(pdf: pd.DataFrame, shots: np.ndarray, bright: int) -> np.ndarray:
    """Channels of the usable cells that any shot covers: (shot, channel, cell), nan where the shot has none."""
    colour = pdf[list(CHANNELS)].to_numpy(np.float32)
    usable = colour.max(1) <= bright
    _, cell = np.unique(pdf["y"].to_numpy(np.int64)[usable] << 32 | pdf["x"].to_numpy(np.int64)[usable], return_inverse=True)
    value = np.full((len(shots), len(CHANNELS), cell.max() + 1 if len(cell) else 0), np.nan, np.float32)
    at = np.searchsorted(shots, pdf["shot"].to_numpy()[usable])
    for c in range(len(CHANNELS)):
        value[at, c, cell] = colour[usable, c]
    return value


def _matched(value: np.ndarray, gains: np.ndarray, k: int, min_cells: int, bright: int) -> np.ndarray:
    """The gains of shot ``k`` against the mean of the others where that is neither dark nor bright."""
    others = [s for s in range(len(value)) if s != k]
    total, n = np.zeros(value.shape[1:]), np.zeros(value.shape[2])
    for s in others:
        there = ~np.isnan(value[s, 0])
        total[:, there] += value[s][:, there] * gains[s][:, None]
        n += there
    both = (n > 0) & ~np.isnan(value[k, 0])
    mean, own = total[:, both] / n[both], value[k][:, both]
    fair = (mean.min(0) > 20) & (mean.max(0) < bright)
    return np.array([_mode_gain(mean[c, fair], own[c, fair], min_cells, gains[k, c]) for c in range(len(CHANNELS))])


def _mode_gain(mean: np.ndarray, own: np.ndarray, min_cells: int, before: float) -> float:
    """The gain at the peak of the smoothed histogram of log ratios; the one before with too few cells."""
    if len(mean) < min_cells:
        return before
    width = (np.log(HIGH) - np.log(LOW)) / BINS
    ratio = np.clip(mean / np.maximum(own, 1), LOW, HIGH)
    counts = np.bincount(np.minimum((np.log(ratio) - np.log(LOW)) / width, BINS - 1).astype(int), minlength=BINS)
    top = int(np.argmax(np.round(np.convolve(counts, gaussian_weights(2.0, 6), "same"), 9)))
    return float(np.clip(np.exp(np.log(LOW) + (top + 0.5) * width), 0.6, 1.6))


def tone_curves(cells: DataFrame, gains: DataFrame, reference: DataFrame, min_agree: int = 2000, min_bin: int = 50) -> DataFrame:
    """A 256-entry tone curve per shot and channel: (page_id, shot, ch, level, value).

    ``gains`` is (page_id, shot, gains[b, g, r]). The curve runs through the
    medians of 8-wide bins of the cells that agree with the other shots,
    straight between them, never falls, and keeps the gain's slope outside;
    without enough agreement it is the gain's line.
    """
    g = cells.join(gains, SHOT)
    gained = g.select(*SHOT, "y", "x", *CHANNELS, *[(F.col(c) * F.get("gains", F.lit(i))).alias(f"m_{c}") for i, c in enumerate(CHANNELS)])
    w = Window.partitionBy(*CELL)
    n = F.count(F.lit(1)).over(w)
    both = gained.withColumn("_n", n - 1)
    for c in CHANNELS:
        both = both.withColumn(f"o_{c}", F.try_divide(F.sum(f"m_{c}").over(w) - F.col(f"m_{c}"), F.col("_n")))
    both = both.filter(F.col("_n") > 0)
    off = F.greatest(*[F.abs(F.col(f"m_{c}") - F.col(f"o_{c}")) for c in CHANNELS])
    agree = both.filter(off < 0.08 * 255 + 0.08 * F.greatest(*[F.col(f"o_{c}") for c in CHANNELS])).join(reference.select(*SHOT), SHOT, "left_anti")
    seen = agree.select(*SHOT, "y", "x", *CHANNELS, *[F.round(f"o_{c}", 6).alias(f"o_{c}") for c in CHANNELS])
    keyed = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in SHOT)
    # One shot's cells are bounded by the grid.
    knots = layers.on_layers(seen, SHOT, lambda l: _knots(l, min_agree, min_bin), f"{keyed}, ch int, u array<double>, v array<double>", 1, 1)
    flat = gains.select(*SHOT, F.posexplode("gains").alias("ch", "gain")).withColumn("gain", F.col("gain").cast("double"))
    curves = flat.join(knots, [*SHOT, "ch"], "left").select(*SHOT, "ch", "gain", "u", "v")
    return curves.mapInArrow(_levels, f"{', '.join(f'{k} {flat.schema[k].dataType.simpleString()}' for k in SHOT)}, ch int, level int, value double")


def _knots(l: layers.Layers, min_agree: int, min_bin: int) -> pa.Table:
    """Per shot and channel the medians of its 8-wide bins with at least ``min_bin`` cells, if there are three of them."""
    enough = (np.bincount(l.layer, minlength=len(l.starts)) >= min_agree)[l.layer]
    rows = []
    for ch, c in enumerate(CHANNELS):
        u, v = l.column(c), l.column(f"o_{c}")
        some = enough & ~np.isnan(u)
        u, v, layer = u[some], v[some], l.layer[some]
        bin_ = np.floor(u / 8)
        by_u, by_v = np.lexsort((u, bin_, layer)), np.lexsort((v, bin_, layer))
        opens = np.ones(len(u), bool)
        opens[1:] = (np.diff(layer[by_u]) != 0) | (np.diff(bin_[by_u]) != 0)
        start = np.flatnonzero(opens)
        n = np.diff(np.append(start, len(u)))
        start, n = start[n >= min_bin], n[n >= min_bin]
        lower, upper = start + (n - 1) // 2, start + n // 2
        middle = lambda a: 0.5 * a[lower] + 0.5 * a[upper]  # noqa: B023, E731
        knots = layer[by_u][start]
        shots, first, count = np.unique(knots, return_index=True, return_counts=True)
        rows += [(shot, ch, *(middle(a)[i : i + k] for a in (u[by_u], v[by_v]))) for shot, i, k in zip(shots, first, count, strict=True) if k >= 3]
    at = pa.array([l.starts[r[0]] for r in rows], pa.int64())
    named = {k: l.table[k].take(at) for k in SHOT}
    curve = lambda i: pa.array([r[i] for r in rows], pa.list_(pa.float64()))
    return pa.table(named | {"ch": pa.array([r[1] for r in rows], pa.int32()), "u": curve(2), "v": curve(3)})


def _curve(gain: float, u: np.ndarray | None, v: np.ndarray | None) -> np.ndarray:
    level = np.arange(256.0)
    raw = level * gain
    if u is not None:
        below, above = np.maximum(np.searchsorted(u, level, "right") - 1, 0), np.minimum(np.searchsorted(u, level, "left"), len(u) - 1)
        wide = u[above] - u[below]
        between = v[below] + (level - u[below]) * (v[above] - v[below]) / np.where(wide == 0, 1.0, wide)
        raw = np.where(level < u[0], level * v[0] / max(u[0], 1.0), np.where(level > u[-1], v[-1] + (level - u[-1]) * gain, between))
    return np.fmin(np.fmax(np.fmax.accumulate(raw), 0.0), 255.0)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 256 values of each curve from its gain and knots, ``_CURVES`` curves at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, _CURVES):
            batch = whole.slice(at, _CURVES)
            n = batch.num_rows
            gain = batch["gain"].to_numpy(zero_copy_only=False).astype(float)
            u, v = ([None if a is None else np.array(a, float) for a in batch[k].to_pylist()] for k in "uv")
            value = np.array([_curve(g, *k) for g, *k in zip(gain, u, v, strict=True)])
            row = pa.array(np.repeat(np.arange(n), 256))
            named = {k: batch[k].take(row) for k in (*SHOT, "ch")}
            yield pa.RecordBatch.from_pydict(named | {"level": pa.array(np.tile(np.arange(256, dtype=np.int32), n)), "value": pa.array(value.reshape(-1))})
