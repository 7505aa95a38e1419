"""Whole layers in shared batches, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.functions import pages as PG
from pagequarry.operators import fusion as FU
from pagequarry.operators import glare as GL
from pagequarry.operators import layers
from pagequarry.operators import regions as R
from pagequarry.operators import shadow as SH
from pagequarry.operators.components import grid_components

W, H = 13, 11


def _cells(spark, n, seed, share=0.5):
    rng = np.random.default_rng(seed)
    rows = [(f"p{k // 3}", k % 3, y, x, *[int(v) for v in rng.integers(0, 256, 3)]) for k in range(n) for y in range(H) for x in range(W) if rng.random() < share]
    return rows, spark.createDataFrame(rows, "page_id string, shot int, y int, x int, b int, g int, r int").repartition(5)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [1, 100, 10**6])
def test_layers_stay_whole_in_any_batch(spark, monkeypatch, rows):
    monkeypatch.setattr(layers, "BATCH_ROWS", rows)
    made, cells = _cells(spark, 20, 3)
    keys = ["page_id", "shot"]
    out = layers.with_columns(cells, keys, lambda l: {"n": np.bincount(l.layer)[l.layer], "k": np.full(len(l.y), len(l.starts))}, {"n": "long", "k": "long"}, W, H).collect()
    want = {}
    for r in made:
        want[r[:2]] = want.get(r[:2], 0) + 1
    assert len(out) == len(made) and all(r.n == want[r.page_id, r.shot] for r in out)


def test_components_of_many_layers_and_null_keys(spark):
    made, cells = _cells(spark, 12, 4, 0.4)
    both = cells.unionByName(cells.withColumn("page_id", F.when(F.col("page_id") == "p1", None).otherwise(F.concat("page_id", F.lit("x")))))
    got = grid_components(both.unionByName(cells), ["page_id", "shot"]).collect()
    assert len(got) == 2 * len(made)  # repeated cells count once
    names = {}
    for r in got:
        names.setdefault((r.page_id, r.shot, r.component), []).append((r.y, r.x))
    for k, at in names.items():
        assert k[2] == min(y * 4096 + x for y, x in at)
    assert all(r.pixels == len(names[r.page_id, r.shot, r.component]) for r in got)


def test_window_fit_needs_neither_widened_rows_nor_joins(spark):
    made, cells = _cells(spark, 6, 5)
    fit = SH.window_fit(SH.with_references(cells), 1, W, H)
    assert "Join" not in _plan(fit) and "Generate" not in _plan(fit)
    pairs = {(r.page_id, r.shot, r.y, r.x): r for r in SH.with_references(cells).collect()}
    for r in fit.collect():
        near = [p for (a, s, y, x), p in pairs.items() if (a, s) == (r.page_id, r.shot) and abs(y - r.y) <= 1 and abs(x - r.x) <= 1]
        assert r.mi_b == pytest.approx(np.mean([p.i_b for p in near])) and r.mq_r == pytest.approx(np.mean([p.q_r for p in near]))


def test_background_is_the_median_around(spark):
    made, cells = _cells(spark, 4, 6, 1.0)
    v = {r[:4]: r[4] for r in made}
    out = GL.background(cells, W, H, back=("b", 1.0))
    assert "Join" not in _plan(out)
    for r in out.collect():
        near = sorted(v[r.page_id, r.shot, y, x] for y in range(max(r.y - 1, 0), min(r.y + 2, H)) for x in range(max(r.x - 1, 0), min(r.x + 2, W)))
        assert r.back == near[len(near) // 2]


def test_detect_and_weights_join_nothing(spark):
    made, cells = _cells(spark, 4, 7)
    d = GL.detect(cells, W, H, min_seed=1, seed=0.35, weak=0.1)
    w = FU.weights(cells.withColumn("excess", F.col("g") / 1000), W, H, reach=2, halo=1)
    assert all("Join" not in _plan(x) and "FlatMapGroupsInPandas" not in _plan(x) for x in (d, w))
    assert d.count() == w.count() == len(made)


def test_extent_of_a_box_walks_no_arrays(spark):
    h = [F.lit(v) for v in (1.0, 0.0, -5.0, 0.0, 1.0, 2.0, 0.01, 0.0, 1.0)]
    df = spark.createDataFrame([(10.0, 20.0), (-100.0, 3.0)], "x double, y double")
    e = df.select("x", "y", PG.shot_box_extent(F.col("x"), F.col("y"), F.col("x") + 40, F.col("y") + 30, h).alias("e"))
    assert "transform(" not in _plan(e) and "lambda" not in _plan(e)
    for r in e.collect():
        k = np.arange(9) / 8
        pts = [(r.x + v * 40, y) for v in k for y in (r.y, r.y + 30)] + [(x, r.y + v * 30) for v in k for x in (r.x, r.x + 40)]
        seen = [((x - 5) / (0.01 * x + 1), (y + 2) / (0.01 * x + 1)) for x, y in pts if 0.01 * x + 1 != 0]
        assert tuple(r.e) == pytest.approx((min(x for x, _ in seen), min(y for _, y in seen), max(x for x, _ in seen), max(y for _, y in seen)))
    rect = PG.shot_box(F.col("e"), F.lit(400), F.lit(300))
    assert e.select(rect.alias("b")).first().b == [4, 14, 30, 48]


def test_a_cell_without_place_joins_no_area(spark):
    cells = spark.createDataFrame([(1, 1, 3, 0.5), (1, None, 3, 0.9), (1, 1, 8, 0.9)], "page_id int, y int, x int, v double")
    got = R.hysteresis(cells, ["page_id"], "v", 0.9, 0.4, 1, W, H).collect()
    assert [(r.y, r.x) for r in got] == [(1, 8)]
