"""Relighting, labels, gains and tone curves on planted data."""

import random

import numpy as np
from pyspark.sql import functions as F

from pagequarry.operators import evaluate as EV
from pagequarry.operators import fusion as FU
from pagequarry.operators import labels as LB
from pagequarry.operators import tone as TN


def _lum(spark, arrays):
    return spark.createDataFrame([(1, s, y, x, float(a[y, x])) for s, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])], "page_id int, shot int, y int, x int, lum double")


def test_relit_takes_a_planted_gain_off_again(spark):
    h, w = 20, 28
    flat = 0.25 + 0.5 * np.random.default_rng(9).random((h, w))
    gain = np.array([[np.exp(0.06 - 0.2 * (x / w - 0.5) + 0.1 * (y / h - 0.5) ** 2) for x in range(w)] for y in range(h)])
    seen = (flat + 0.02) * gain - 0.02
    spots = [(3, 4), (10, 20), (15, 9)]
    for y, x in spots:
        seen[y, x] += 0.05  # outliers that the second fit leaves out
    rows = [(1, 0, y, x, float(seen[y, x]), float(flat[y, x]), True) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "page_id int, shot int, y int, x int, lum double, ref double, sel boolean")
    got = {(r.y, r.x): r.lum for r in LB.relit(df, w, h, step=1, min_cells=50).collect()}
    off = {k: abs(v - flat[k]) for k, v in got.items()}
    assert max(v for k, v in off.items() if k not in spots) < 1e-4 and all(off[k] > 0.03 for k in spots)


def test_a_slope_of_light_gives_no_labels_after_relighting(spark):
    h, w = 32, 48
    even = np.full((h, w), 0.4)
    sloped = even * (1 + 0.5 * np.arange(h)[:, None] / h)
    cells = _lum(spark, [even, even, sloped])
    glare = lambda on: LB.overlap_labels(cells, w, h, shift=1, relight=on, step=1).filter("shot = 2 and label = 1").count()
    assert glare(False) > 100 and glare(True) == 0


def test_gains_bring_a_darker_shot_to_the_reference(spark):
    rng = np.random.default_rng(4)
    h, w = 30, 40
    a = rng.integers(60, 200, (h, w, 3))
    b = (a * 0.8).round().astype(int)
    rows = [(1, s, y, x, *[int(v) for v in img[y, x]]) for s, img in enumerate((a, b)) for y in range(h) for x in range(w)]
    cells = spark.createDataFrame(rows, "page_id int, shot int, y int, x int, b int, g int, r int")
    ref = spark.createDataFrame([(1, 0)], "page_id int, shot int")
    g = {r.shot: r.gains for r in TN.exposure_gains(cells, ref, rounds=1).collect()}
    assert g[0] == [1.0, 1.0, 1.0]
    assert all(abs(v - 1.25) < 0.05 for v in g[1])
    curve = TN.tone_curves(cells, spark.createDataFrame([(1, 0, [1.0] * 3), (1, 1, g[1])], "page_id int, shot int, gains array<double>"), ref, min_agree=200, min_bin=20)
    v = {r.level: r.value for r in curve.filter("shot = 1 AND ch = 0").collect()}
    assert abs(v[100] - 125) < 3 and all(v[i] <= v[i + 1] for i in range(255))


def test_logistic_fit_separates_and_keeps_weights_non_negative(spark):
    rng = np.random.default_rng(7)
    y = rng.random(3000) < 0.3
    good, noise, bad = rng.normal(y * 1.0, 0.4), rng.normal(0, 1, 3000), rng.normal(-1.0 * y, 0.5)
    df = spark.createDataFrame([(int(a), float(b), float(c), float(d)) for a, b, c, d in zip(y, good, noise, bad)], "label int, good double, noise double, bad double")
    f = EV.fit_logistic(df, ["good", "noise", "bad"], clean_weight=1.0)
    assert f["good"] > 2 and f["bad"] == 0 and f["noise"] >= 0


def test_a_tone_curve_runs_through_the_medians_of_its_bins(spark):
    rng = np.random.default_rng(6)
    h, w = 24, 30
    a = rng.integers(20, 200, (h, w))
    b = np.clip(a - rng.integers(0, 12, (h, w)), 0, 255)
    rows = [(1, s, y, x, *[int(img[y, x])] * 3) for s, img in enumerate((a, b)) for y in range(h) for x in range(w)]
    cells = spark.createDataFrame(rows, "page_id int, shot int, y int, x int, b int, g int, r int")
    gains = spark.createDataFrame([(1, 0, [1.0] * 3), (1, 1, [1.0] * 3), (2, 0, [0.5] * 3)], "page_id int, shot int, gains array<double>")
    curve = TN.tone_curves(cells, gains, spark.createDataFrame([(1, 0)], "page_id int, shot int"), min_agree=100, min_bin=5)
    assert "percentile" not in curve._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.page_id, r.shot, r.ch, r.level): r.value for r in curve.collect()}
    assert len(got) == 3 * 3 * 256 and all(got[2, 0, ch, i] == 0.5 * i and got[1, 0, ch, i] == i for ch in range(3) for i in range(256))
    u, v = b.reshape(-1).astype(float), a.reshape(-1).astype(float)
    agree = np.abs(u - v) < 0.08 * 255 + 0.08 * v
    knots = [(np.median(u[s]), np.median(v[s])) for s in (agree & (u // 8 == k) for k in range(32)) if s.sum() >= 5]
    ku, kv = (np.array(k) for k in zip(*knots))
    level = np.arange(256.0)
    want = np.where(level < ku[0], level * kv[0] / ku[0], np.where(level > ku[-1], kv[-1] + level - ku[-1], np.interp(level, ku, kv)))
    assert np.allclose([got[1, 1, 1, i] for i in range(256)], np.clip(np.maximum.accumulate(want), 0, 255))


def test_relighting_is_one_pass_over_each_shot(spark):
    rng = np.random.default_rng(8)
    h, w = 12, 16
    ref = rng.uniform(0.3, 0.6, (h, w))
    y, x = np.indices((h, w))
    lum = (ref + 0.02) * np.exp(0.3 * (x / w - 0.5) - 0.2 * (y / h - 0.5) ** 2) - 0.02
    rows = [(1, s, int(i), int(j), float(lum[i, j]), float(ref[i, j]), s != 2) for s in (1, 2, None) for i in range(h) for j in range(w)]
    out = LB.relit(spark.createDataFrame(rows, "page_id int, shot int, y int, x int, lum double, ref double, sel boolean"), w, h, glare=0.5, step=1, min_cells=20)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.shot, r.y, r.x): r.lum for r in out.collect()}
    assert len(got) == len(rows)
    assert all(abs(got[1, i, j] - ref[i, j]) < 1e-9 and got[2, i, j] == got[None, i, j] == lum[i, j] for i in range(h) for j in range(w))


def test_a_page_is_labelled_in_one_pass(spark):
    from pagequarry.operators.grid import erode, local_max, opened

    rng = random.Random(2)
    rows = [(p, s, y, x, 0.3 + 0.01 * x * (s or 0) + rng.random() / 5 + (0.4 if rng.random() < 0.1 else 0)) for p in range(3) for s in (0, 1, 2, None) for y in range(10) for x in range(12) if rng.random() < 0.93 and x >= 2 * (s or 0)]
    rows += [(0, 0, None, 3, 0.4), (0, 1, 2, None, 0.4), (None, 1, 2, 2, 0.4), (1, 5, 0, 0, None), (1, 5, 0, 1, 0.2), (2, 0, 12, 3, 0.3)]
    cells = spark.createDataFrame(rows, "page_id int, shot int, y int, x int, lum double").cache()
    at, cell = ["page_id", "shot", "y", "x"], ["page_id", "y", "x"]
    with_reference = lambda c: c.drop("ref").join(FU.low_percentile(c, "lum", 25.0, "ref").select(*cell, "ref"), cell)
    want = with_reference(FU.coverage_counted(cells).withColumn("sel", F.col("shots") >= 2))
    for _ in range(2):
        want = with_reference(LB.relit(want.localCheckpoint(), 12, 10, step=1, min_cells=20).localCheckpoint())
    want = want.localCheckpoint()
    high = local_max(want.filter("y < 10").select(*cell, "ref").distinct(), ["page_id"], "ref", 1, 12, 10, "high")
    label = F.when(F.col("sel") & (F.col("lum") - F.col("ref") <= 0.02), 0).when(F.col("sel") & (F.col("lum") - F.col("high") >= 0.08), 1)
    want = want.join(high, cell).select(*at, "lum", "ref", label.alias("label"))
    out = LB.overlap_labels(cells, 12, 10, shift=1, step=1, min_cells=20)
    rounded = lambda df: sorted((tuple(None if v is None else round(v, 9) for v in r) for r in df.collect()), key=str)
    got = rounded(out.select(*at, "lum", "ref", "label"))
    assert got == rounded(want) and len(got) == len(rows) - 4 and {0, 1} < {r[6] for r in got}
    assert all(word not in out._jdf.queryExecution().optimizedPlan().toString() for word in ("Join", "Window", "Aggregate"))
    # Labels are cleaned in one pass too, whatever the cells' places.
    marked = cells.withColumn("label", F.when(F.col("lum") > 0.35, 1).when(F.col("lum") > 0.32, 0)).select(*at, "label")
    inner, solid = erode(marked.filter("y < 10"), at[:2], 2, 12, 10).withColumn("i", F.lit(1)), opened(marked.filter("label = 1 AND y < 10"), at[:2], 1, 12, 10).withColumn("s", F.lit(1))
    keep = F.col("i").isNotNull() & ((F.col("label") != 1) | F.col("s").isNotNull())
    clean = LB.cleaned_labels(marked, 12, 10, rim=2)
    assert "Join" not in clean._jdf.queryExecution().optimizedPlan().toString()
    assert rounded(clean) == rounded(marked.join(inner, at, "left").join(solid, at, "left").select(*at, F.when(keep, F.col("label")).alias("label")))
