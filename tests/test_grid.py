"""Grid neighbourhoods, components and regions against array brute force and known cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.operators import fusion as FU
from pagequarry.operators import glare as GL
from pagequarry.operators import grid as G
from pagequarry.operators import regions as R
from pagequarry.operators.components import graph_components, grid_components


def _mask(spark, a, page=1):
    return spark.createDataFrame([(page, int(y), int(x)) for y, x in zip(*np.nonzero(a))], "page_id int, y int, x int")


def _array(df, shape):
    out = np.zeros(shape, bool)
    for r in df.collect():
        out[r.y, r.x] = True
    return out


def _neigh(a, r, how, pad):
    h, w = a.shape
    p = np.pad(a, r, constant_values=pad)
    stack = [p[r + dy : r + dy + h, r + dx : r + dx + w] for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    return how(stack, axis=0)


def _labels(a):
    lab, n = np.zeros(a.shape, int), 0
    for y, x in zip(*np.nonzero(a)):
        if lab[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        lab[y, x] = n
        while todo:
            cy, cx = todo.pop()
            for ny in range(max(cy - 1, 0), min(cy + 2, a.shape[0])):
                for nx in range(max(cx - 1, 0), min(cx + 2, a.shape[1])):
                    if a[ny, nx] and not lab[ny, nx]:
                        lab[ny, nx] = n
                        todo.append((ny, nx))
    return lab


def test_morphology_matches_arrays(spark):
    a = np.random.default_rng(1).random((17, 23)) < 0.6
    m = _mask(spark, a)
    for r in (1, 2):
        assert (_array(G.dilate(m, ["page_id"], r, 23, 17), a.shape) == _neigh(a, r, np.any, False)).all()
        assert (_array(G.erode(m, ["page_id"], r, 23, 17), a.shape) == _neigh(a, r, np.all, True)).all()
    closed = _neigh(_neigh(a, 1, np.any, False), 1, np.all, True)
    assert (_array(G.closed(m, ["page_id"], 1, 23, 17), a.shape) == closed).all()


def test_components_match_flood_fill(spark):
    a = np.random.default_rng(5).random((40, 60)) < 0.38
    lab = _labels(a)
    rows = grid_components(_mask(spark, a), ["page_id"]).collect()
    assert len(rows) == a.sum()
    mine = {}
    for r in rows:
        mine.setdefault(r.component, set()).add(lab[r.y, r.x])
        assert r.pixels == (lab == lab[r.y, r.x]).sum()
    assert all(len(s) == 1 for s in mine.values())
    assert len(mine) == lab.max()


def test_graph_components_on_a_long_chain(spark):
    n = 300
    nodes = spark.createDataFrame([(1, i) for i in range(n + 2)], "k int, node int")
    edges = spark.createDataFrame([(1, i + 1, i) for i in range(n - 1)] + [(1, n, n + 1)], "k int, a int, b int")
    got = {r.node: r.component for r in graph_components(nodes, edges, ["k"]).collect()}
    assert got == {**{i: 0 for i in range(n)}, n: n, n + 1: n}


def test_regions_of_known_boxes(spark):
    a = np.zeros((100, 200), bool)
    for x0, y0, x1, y1 in ((10, 10, 30, 20), (150, 70, 190, 95), (100, 45, 101, 46)):
        a[y0:y1, x0:x1] = True
    cells = R.region_cells(_mask(spark, a), ["page_id"], 200, 100, 0.0005)
    rows = R.region_stats(cells, ["page_id"], 200, 100, 2000, 1000).orderBy("ord").collect()
    assert [(r.location, r.area) for r in rows] == [("bottom-right", 0.05), ("top-left", 0.01)]
    assert (rows[0].px0, rows[0].py0, rows[0].px1, rows[0].py1) == (1500, 700, 1900, 950)
    assert (rows[1].fx0, rows[1].fy0, rows[1].fx1, rows[1].fy1) == (0.05, 0.1, 0.15, 0.2)


def test_hairline_is_closed_into_one_region(spark):
    a = np.zeros((100, 200), bool)
    a[10:40, 10:60] = True
    a[:, 35] = False
    assert R.region_cells(_mask(spark, a), ["page_id"], 200, 100, 0.0005).select("component").distinct().count() == 1


def test_causes_of_two_overlapping_shots(spark):
    h, w = 100, 200
    s0, s1 = np.zeros((h, w), bool), np.zeros((h, w), bool)
    s0[:, :120], s1[:, 80:] = True, True
    res = np.zeros((h, w))
    for (x0, x1), v in (((10, 30), 0.8), ((90, 110), 0.6), ((160, 180), 0.9)):
        res[40:60, x0:x1] = v
    cells = spark.createDataFrame([(1, s, int(y), int(x)) for s, m in ((0, s0), (1, s1)) for y, x in zip(*np.nonzero(m))], "page_id int, shot int, y int, x int")
    resid = spark.createDataFrame([(1, int(y), int(x), float(res[y, x])) for y, x in zip(*np.nonzero(res))], "page_id int, y int, x int, residual double")
    rows = R.glare_regions(resid, cells, ["page_id"], w, h, 2000, 1000).orderBy("px0").collect()
    assert [(r.cause, r.shots, r.severity) for r in rows] == [("single_shot", [0], 0.8), ("all_shots_glared", [0, 1], 0.6), ("single_shot", [1], 0.9)]


def test_single_coverage_seam_and_small_patch_go(spark):
    h, w = 100, 200
    s0, s1 = np.ones((h, w), bool), np.ones((h, w), bool)
    s1[:, 150:] = False
    s0[:, 40:42] = False  # a thin seam only shot 1 covers
    s1[50:53, 20:24] = False  # a small patch
    cells = spark.createDataFrame([(1, s, int(y), int(x)) for s, m in ((0, s0), (1, s1)) for y, x in zip(*np.nonzero(m))], "page_id int, shot int, y int, x int")
    rows = R.single_regions(cells, ["page_id"], w, h, 2000, 1000).collect()
    assert [(r.location, r.shot, r.edges, r.glare_seen) for r in rows] == [("right", 0, ["top", "right", "bottom"], None)]


def test_cells_off_the_grid_are_refused(spark):
    bad = spark.createDataFrame([(1, 0, 30)], "page_id int, y int, x int")
    with pytest.raises(Exception, match="cell off the grid"):
        G.checked(bad, 25, 20).collect()


def test_leave_one_out_takes_the_darker_middle_value(spark):
    cells = spark.createDataFrame([(1, s, 0, 0, v) for s, v in enumerate((0.9, 0.2, 0.8, 0.3))] + [(1, 0, 1, 0, 0.5), (1, 1, 1, 0, 0.7)], "page_id int, shot int, y int, x int, v double")
    rows = {(r.y, r.shot): (r.others, r.reference) for r in FU.leave_one_out(cells, "v").collect()}
    assert all(rows[(0, s)] == (3, 0.3) for s in range(4))
    assert rows[(1, 0)] == (1, 0.7) and rows[(1, 1)] == (1, 0.5)


def test_background_of_a_large_grid_follows_a_plain_median(spark):
    h, w = 40, 520  # wide enough for a coarse grid of two
    a = np.tile(np.linspace(0, 200, w), (h, 1)).round()
    cells = spark.createDataFrame([(1, 0, y, x, float(a[y, x])) for y in range(h) for x in range(w)], "page_id int, shot int, y int, x int, v double")
    assert GL.coarse_factor(w, h)[1] == 2
    rows = GL.background(cells, w, h, bg=("v", 1.0)).filter("x between 40 and 480").agg(F.max(F.abs(F.col("bg") - F.col("v")))).first()[0]
    assert rows <= 1.5


def test_detection_finds_a_planted_veil(spark):
    rng = np.random.default_rng(0)
    h, w = 60, 80
    img = rng.integers(30, 60, (h, w, 3))
    img[20:23, 30:33] = 255  # smaller than the background window
    cells = spark.createDataFrame([(1, 0, y, x, *[int(v) for v in img[y, x]]) for y in range(h) for x in range(w)], "page_id int, shot int, y int, x int, b int, g int, r int")
    hit = _array(GL.detect(cells, w, h, min_seed=3).filter("glare > 0"), (h, w))
    assert hit[20:23, 30:33].all() and hit.sum() < 60


def test_disk_maxima_equal_the_whole_ellipse(spark):
    r = random.Random(3)
    w, h = 23, 17
    cells = [(k, y, x, r.randrange(100)) for k in range(2) for y in range(h) for x in range(w) if r.random() < 0.25] + [(0, 0, 0, 7), (0, 0, 0, 3)]
    df = spark.createDataFrame(cells, "k int, y int, x int, v int")
    for radius in (1, 2, 5, 40):
        want = {}
        for k, y, x, v in cells:
            for dy, wide in G.disk_offsets(radius):
                for xx in range(max(0, x - wide), min(w, x + wide + 1)):
                    if 0 <= y + dy < h:
                        want[k, y + dy, xx] = max(v, want.get((k, y + dy, xx), -1))
        assert {(c.k, c.y, c.x): c.top for c in G.local_max_disk(df, ["k"], "v", radius, w, h, "top").collect()} == want


def test_area_averages_for_any_factor(spark):
    r = random.Random(4)
    gw, gh = 11, 7
    cells = {(y, x): r.randrange(1, 50) for y in range(gh) for x in range(gw) if r.random() < 0.7}
    df = spark.createDataFrame([(1, y, x, v) for (y, x), v in cells.items()], "k int, y int, x int, v int")
    for nw, nh in ((11, 7), (4, 3), (5, 2), (1, 1), (10, 6)):
        want = {}
        for j in range(nh):
            for i in range(nw):
                area = lambda lo, hi, at: max(0.0, min(hi, at + 1) - max(lo, at))
                terms = [(v, area(i * gw / nw, (i + 1) * gw / nw, x) * area(j * gh / nh, (j + 1) * gh / nh, y)) for (y, x), v in cells.items()]
                if any(a > 1e-9 for _, a in terms):
                    want[j, i] = sum(v * a for v, a in terms) / (gw / nw * gh / nh)
        got = {(c.y, c.x): c.mean for c in G.resized(df, ["k"], nw, nh, gw, gh, mean=F.col("v")).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_payloads_carry_regions_and_boxes(spark):
    from pagequarry.plans.quality import assess, payloads

    w, h = 20, 16
    cells = [(1, s, y, x, 1.0, 0.9 if y < 6 and x < 6 and s == 1 else 0.0, 0.0) for s in (1, 2) for y in range(h) for x in range(w) if not (x >= 14 and s == 2) and y < 12 and not (s == 2 and y < 6 and x < 6)]
    df = spark.createDataFrame(cells, "page_id int, shot int, y int, x int, weight double, glare double, shadow double")
    mappers = spark.createDataFrame([(1, 1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 200, 160), (1, 2, [1.0, 0.0, -500.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 200, 160)], "page_id int, shot int, h array<double>, width int, height int")
    dropped = spark.createDataFrame([(1, 3)], "page_id int, photo int")
    q = assess(df, w, h, 200, 160, dropped=dropped, threshold=0.5, min_region=0.01, min_single=0.01)
    got = {r.code: r for r in payloads(q, mappers).collect()}
    assert set(got) == {"glare", "incomplete_coverage", "single_coverage", "photos_dropped"}
    glare = got["glare"]
    assert (glare.single_shot, glare.all_shots, glare.location, glare.locations) == (1, 0, "top-left", None)
    box = glare.regions[0]
    assert box.bbox_px[:2] == [0, 0] and set(box.shot_boxes) == {1} and box.shot_boxes[1] == box.bbox_px and box.cause == "single_shot" and list(box.shots) == [1]
    gap = got["incomplete_coverage"]
    assert gap.locations == ["bottom"] and gap.fraction == 0.25 and gap.single_shot is None and gap.regions[0].edges == ["right", "bottom", "left"]
    one = got["single_coverage"]
    assert len(one.regions) == 2 and one.glare_seen_regions == 1 and [r.location for r in one.regions] == one.locations
    assert got["photos_dropped"].regions is None and got["photos_dropped"].message.startswith("Photo 3")
    assert all(r.shot_boxes is None for p in payloads(q).collect() for r in p.regions or [])


def test_boxes_filled_together_give_each_cell_once(spark):
    rng = random.Random(2)
    rows = [(p, *[rng.uniform(0, 0.9) for _ in range(2)], *[rng.uniform(0.05, 0.3) for _ in range(2)]) for p in (1, 1, 2, None) for _ in range(15)]
    rows += rows[:3] + [(3, None, 0.1, 0.1, 0.1), (4, 0.5, 0.5, -0.5, 0.1)]
    df = spark.createDataFrame([(p, x, y, None if x is None else x + w, y + h) for p, x, y, w, h in rows], "page_id long, x0 double, y0 double, x1 double, y1 double")
    at = lambda d: sorted((r.page_id or 0, r.y, r.x) for r in d.collect())
    once = G.box_fill(df, 25, 20, once=True)
    assert at(once) == at(G.box_fill(df, 25, 20).distinct()) and once.schema[1:] == G.box_fill(df, 25, 20).schema[1:]
    assert at(G.box_fill(df, 200, 20, once=True)) == at(G.box_fill(df, 200, 20).distinct())
