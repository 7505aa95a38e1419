"""Match trees, replays and their summaries on known cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from pagequarry.operators import matching as MA
from pagequarry.operators import replay as RP


def _cells(spark, masks):
    return spark.createDataFrame([(1, s, int(y), int(x)) for s, m in enumerate(masks) for y, x in zip(*np.nonzero(m))], "page_id int, shot int, y int, x int")


def _span(*parts, w=100, h=40):
    m = np.zeros((h, w), bool)
    for a, b in parts:
        m[:, a:b] = True
    return m


def test_stitch_pairs(spark):
    # Two halves with some overlap stitch; a whole shot, or one with nothing of its own, does not.
    cells = _cells(spark, [_span((0, 60)), _span((50, 100)), _span((0, 100)), _span((40, 100)), _span((80, 100))])
    rows = RP.stitch_pairs(RP.pair_shares(cells)).orderBy("rank").collect()
    assert [(r.a, r.b) for r in rows] == [(0, 1), (0, 3)]


def test_whole_shots_spread(spark):
    full, part = _span((0, 100)), _span((0, 90))
    cells = _cells(spark, [full, full, part, full, full, full])
    assert sorted(r.shot for r in RP.whole_shots(cells).collect()) == [0, 1, 4, 5]


def test_prompted_shot(spark):
    cells = _cells(spark, [_span((0, 100)), _span((0, 55)), _span((0, 60)), _span((0, 20))])
    box = spark.createDataFrame([(1, "r", y, x) for y in range(40) for x in range(100)], "page_id int, rid string, y int, x int")
    used = spark.createDataFrame([(1, "r", 0)], "page_id int, rid string, shot int")
    pick = lambda rule: [r.shot for r in RP.prompted(box, cells, used, rule).collect()]
    assert pick("best") == [2] and pick("worst") == [1]


def test_replay_adds_the_missing_half(spark):
    cells = _cells(spark, [_span((0, 60)), _span((40, 100)), _span((0, 100))]).withColumn("lum", F.when((F.col("shot") == 0) & (F.col("x") < 10), 0.9).otherwise(0.5))
    starts = spark.createDataFrame([(1, "a", "best", 0), (1, "a", "best", 1)], "page_id int, rid string, rule string, shot int")
    r = RP.replays(starts, cells, 100, 40, RP.darkest_composer(cells, 0.08)).first()
    assert (r.kind, r.shots, r.page_px, r.glare_px, r.single_glare_px, r.removed_1, r.removed_2) == ("stitch", [0, 1, 2], 4000, 400, 400, 400, 400)


def test_summary_and_gate(spark):
    rows = [("best", "stitch", 1000, 100, 50, 30, 48), ("best", "stitch", 1000, 100, 50, 30, 48)]
    df = spark.createDataFrame(rows, "rule string, kind string, page_px long, glare_px long, single_glare_px long, removed_1 long, removed_2 long")
    s = RP.summarised(df).filter("kind IS NULL").first()
    assert (s.removed_1, s.removed_2, s.single_glare) == (0.6, 0.96, 0.05)
    zero = RP.summarised(df.withColumn("single_glare_px", F.lit(0))).first()
    assert zero.removed_1 is None
    g = spark.createDataFrame([(0.96, 0.1), (0.79, 0.0), (None, 0.0), (0.9, 0.11)], "r double, u double")
    assert [x[0] for x in g.select(RP.gate(F.col("r"), F.col("u"))).collect()] == [True, False, False, False]


def test_match_tree_is_a_maximum_spanning_tree(spark):
    shift = lambda x: [1.0, 0.0, float(x), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    photo = spark.createDataFrame([(1, i) for i in range(5)], "page_id int, photo int")
    pair = spark.createDataFrame([(1, 0, 1, 50, shift(1)), (1, 1, 2, 80, shift(2)), (1, 0, 2, 40, shift(9)), (1, 2, 3, 40, shift(4))], "page_id int, a int, b int, inliers int, h array<double>")
    rows = {r.photo: r for r in MA.match_tree(photo, pair).collect()}
    assert {p: (rows[p].parent, rows[p].placed) for p in rows} == {2: (None, 0), 1: (2, 1), 0: (1, 2), 3: (2, 3), 4: (None, None)}
    # Photo 0 reaches the reference through photo 1: shifts add up; photo 3 goes against its pair's map.
    assert rows[0].to_reference[2] == 3 and rows[3].to_reference[2] == -4
    assert {r.photo: r.reached for r in MA.reached(photo, pair).collect()} == {0: True, 1: True, 2: True, 3: True, 4: False}


def test_nearest_in_small_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.random((60, 4))
    df = spark.createDataFrame([(1, i, v[i].tolist()) for i in range(60)], "page_id int, point long, vec array<double>")
    got = {r.point: [n.other for n in r.near] for r in MA.nearest(df, df, ["page_id"], 3, block=7).collect()}
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    assert got == {i: np.argsort(d[i])[:3].tolist() for i in range(60)}


def test_bent_chain_is_pieced_together(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 0.0, 50.0, 0.0), (1, 1, 52.0, 0.0, 100.0, 2.0), (1, 2, 0.0, 30.0, 100.0, 30.0), (1, 3, 100.0, 31.0, 0.0, 31.0)], "page_id int, seg int, x1 double, y1 double, x2 double, y2 double")
    ch = {r.seg: r.chain for r in MA.chains(seg, 6, 4.0, 1.5).collect()}
    assert ch == {0: 0, 1: 0, 2: 2, 3: 3}


def test_nearest_in_plane_is_exact(spark):
    r = random.Random(5)
    rows = [("a", i, r.random(), r.random()) for i in range(150)] + [("a", 150 + i, 5 + r.random() / 100, 5 + r.random() / 100) for i in range(60)] + [("a", 300 + i, 0.5, 0.5) for i in range(12)]
    rows += [("b", i, float(i), 0.0) for i in range(30)] + [("c", i, 1.0, 1.0) for i in range(5)] + [("d", 0, 2.0, 3.0), ("e", 0, 0.0, 0.0), ("e", 1, 1e6, 1e6), ("e", 2, 1e-6, 0.0)]
    df = spark.createDataFrame(rows, "page string, point long, x double, y double")
    for k in (1, 4, 9):
        want = {}
        for page, p, x, y in rows:
            want[page, p] = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), q) for g, q, u, v in rows if g == page)[:k]
        got = {(n.page, n.point): [(m.d, m.other) for m in n.near] for n in MA.nearest_in_plane(df, ["page"], k).collect()}
        assert got == want


def test_only_linked_nodes_enter_the_rounds_of_components(spark):
    import glob

    from pagequarry.operators.components import graph_components
    from pagequarry.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{folder}/components-*"))
    nodes = spark.range(1000).selectExpr("id % 2 AS k", "id AS node")
    got = {r.node: r.component for r in graph_components(nodes, spark.createDataFrame([(0, 2, 4), (0, 8, 4), (1, 3, 1999)], "k long, a long, b long"), ["k"]).collect()}
    assert len(got) == 1000 and got[2] == got[4] == got[8] == 2 and got[3] == 3 and got[997] == 997
    (made,) = set(glob.glob(f"{folder}/components-*")) - before
    assert all(spark.read.parquet(t).count() <= 6 for t in glob.glob(f"{made}/*"))


def test_segments_meet_however_their_ends_lie(spark):
    import math
    import random

    rng = random.Random(5)
    rows = []
    for i in range(400):
        x, y, dx, dy = rng.randint(-40, 40) * 0.75, rng.randint(-40, 40) * 0.75, rng.choice((-5.0, 5.0)), rng.choice((-0.25, 0.0, 0.25, 4.0))
        rows.append((i % 3, i, x, y, x + dx, y + dy))
    rows += [(0, 900, 1.0, 1.0, 1.0, 1.0), (None, 901, 0.0, 0.0, 5.0, 0.0), (None, 902, 5.0, 0.0, 9.0, 0.0), (1, 903, None, 0.0, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "page_id long, seg long, x1 double, y1 double, x2 double, y2 double")
    want = set()
    ok = [r for r in rows if r[0] is not None and None not in r and (r[2], r[3]) != (r[4], r[5])]
    for a in ok:
        for b in ok:
            if a[0] != b[0] or a[1] >= b[1]:
                continue
            (ux, uy), (vx, vy) = [((s[4] - s[2]) / math.hypot(s[4] - s[2], s[5] - s[3]), (s[5] - s[3]) / math.hypot(s[4] - s[2], s[5] - s[3])) for s in (a, b)]
            if ux * vx + uy * vy < math.cos(math.radians(6)):
                continue
            d, _, px, py, qx, qy = min((math.hypot(p[0] - q[0], p[1] - q[1]), i, *p, *q) for i, (p, q) in enumerate((p, q) for p in (a[2:4], a[4:6]) for q in (b[2:4], b[4:6])))
            if d <= 3 and abs((qx - a[2]) * uy - (qy - a[3]) * ux) <= 1 and abs((px - b[2]) * vy - (py - b[3]) * vx) <= 1:
                want.add((a[0], a[1], b[1]))
    links = MA.segment_links(df, 6, 3.0, 1.0)
    got = [tuple(r) for r in links.collect()]
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want


def test_straightness_meets_directions_before_it_samples(spark):
    rng = random.Random(3)
    rows = [(p, s, s % 3, *[rng.uniform(0, 50) for _ in range(4)]) for p in (1, 2) for s in range(20)]
    df = spark.createDataFrame(rows, "page_id int, seg int, chain int, x1 double, y1 double, x2 double, y2 double")
    out = MA.straightness(df.drop("chain"), df.select("page_id", "seg", "chain"), 0.0)
    got = {(r.page_id, r.chain): (r.pieces, r.span, r.deviation) for r in out.collect()}
    for p, chain in got:
        pts = []
        for _, _, _, x1, y1, x2, y2 in (r for r in rows if (r[0], r[2]) == (p, chain)):
            n = max(2, math.floor(math.hypot(x2 - x1, y2 - y1) / 2))
            pts += [(x1 + k / (n - 1) * (x2 - x1), y1 + k / (n - 1) * (y2 - y1)) for k in range(n)]
        a = np.array(pts) - np.mean(pts, axis=0)
        v = np.linalg.eigh(a.T @ a)[1]
        along, off = a @ v[:, 1], a @ v[:, 0]
        assert np.allclose(got[p, chain], (sum((r[0], r[2]) == (p, chain) for r in rows), along.max() - along.min(), np.abs(off).max()))
    assert len(got) == 6
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("covar_pop" in line and "distinct" in line for line in plan.splitlines())


def test_replays_stay_within_their_pages(spark):
    from pagequarry.operators.grid import box_fill
    from pagequarry.operators.regions import single_regions

    rng = random.Random(8)
    rows = []
    for p in range(6):
        for s in (0, 1, 2, 3, None):
            y0, x0 = rng.randint(0, 5), rng.randint(0, 8)
            rows += [(p, s, y, x, rng.random()) for y in range(y0, y0 + 8) for x in range(x0, x0 + 12) if y < 12 and x < 16 and rng.random() < 0.97]
    rows += [(0, 1, None, 3, 0.5), (1, 2, 4, 4, None), (None, 1, 3, 3, 0.5)]
    cells = spark.createDataFrame(rows, "page_id int, shot int, y int, x int, lum double")
    begun = [(p, f"{a}-{b}/{rule}", rule, s) for p in range(6) for a, b in ((0, 1), (2, 2), (1, 3)) for rule in ("best", "worst") for s in {a, b}]
    starts = spark.createDataFrame([*begun, (1, "none", "best", None), (9, "gone", "best", 0)], "page_id int, rid string, rule string, shot int")

    class Within(RP.DarkestComposer):
        def __call__(self, shots):
            raise AssertionError("glare cells of compositions as a table")

    got = {(r.page_id, r.rid): tuple(r) for r in RP.replays(starts, cells, 16, 12, Within(cells, 0.08), min_area=0.01).collect()}
    compose = RP.darkest_composer(cells, 0.08)
    apart = {(r.page_id, r.rid): tuple(r) for r in RP.replays(starts, cells, 16, 12, lambda shots: compose(shots), min_area=0.01).collect()}
    assert got == apart and len(got) == 37 and got[1, "none"][4:9] == ([], got[1, "none"][5], 0, 0, 0)
    assert sum(r[8] for r in got.values()) > 0 and sum(r[9] for r in got.values()) > sum(r[8] for r in got.values())
    # The first prompt is what the operators for regions, boxes and prompts give.
    rid = ["page_id", "rid"]
    covered = starts.select(*rid, "shot").distinct().join(cells, ["page_id", "shot"])
    top = single_regions(covered, rid, 16, 12, 16, 12, min_area=0.01).filter("ord = 1")
    box = box_fill(top.select(*rid, F.col("fx0").alias("x0"), F.col("fy0").alias("y0"), F.col("fx1").alias("x1"), F.col("fy1").alias("y1")), 16, 12)
    choice = {tuple(r[:2]): (r.best, r.shot) for r in RP.prompted(box, cells, starts.select(*rid, "shot"), "worst").select(*rid, "best", "shot").collect()}
    one = {(r.page_id, r.rid): (r.rule, r.shots) for r in RP.replays(starts, cells, 16, 12, compose, prompts=1, min_area=0.01).collect()}
    more = 0
    for key, (rule, shots) in one.items():
        first = {b[3] for b in begun if b[:2] == key}
        add = choice.get(key, (None, None))[rule != "best"]
        assert shots == sorted(first | ({add} - {None}))
        more += len(shots) - len(first)
    assert more > 6


def test_segments_meet_in_blocks_of_squares(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for i in range(700):
        x, y, dx, dy = rng.randint(-260, 260) * 0.5, rng.choice((-97.0, -96.5, -1.0, 0.0, 0.5, 95.0, 96.0)), rng.choice((-5.0, 5.0, 150.0)), rng.choice((-0.25, 0.0, 0.25))
        rows.append((i % 2, i, x, y, x + dx, y + dy))
    rows += rows[:20] + [(0, 900, 1.0, 1.0, 1.0, 1.0), (None, 901, 0.0, 0.0, 5.0, 0.0), (None, 902, 5.0, 0.0, 9.0, 0.0), (1, 903, None, 0.0, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "page_id long, seg long, x1 double, y1 double, x2 double, y2 double")
    want = set()
    ok = [r for r in set(rows) if r[0] is not None and None not in r and (r[2], r[3]) != (r[4], r[5])]
    way = {s: ((s[4] - s[2]) / math.hypot(s[4] - s[2], s[5] - s[3]), (s[5] - s[3]) / math.hypot(s[4] - s[2], s[5] - s[3])) for s in ok}
    for a in ok:
        for b in ok:
            if a[0] != b[0] or a[1] >= b[1] or way[a][0] * way[b][0] + way[a][1] * way[b][1] < math.cos(math.radians(6)):
                continue
            (ux, uy), (vx, vy) = way[a], way[b]
            d, _, px, py, qx, qy = min((math.hypot(p[0] - q[0], p[1] - q[1]), i, *p, *q) for i, (p, q) in enumerate((p, q) for p in (a[2:4], a[4:6]) for q in (b[2:4], b[4:6])))
            if d <= 3 and abs((qx - a[2]) * uy - (qy - a[3]) * ux) <= 1 and abs((px - b[2]) * vy - (py - b[3]) * vx) <= 1:
                want.add((a[0], a[1], b[1]))
    links = MA.segment_links(df, 6, 3.0, 1.0)
    got = [tuple(r) for r in links.collect()]
    assert len(want) > 1000 and len(got) == len(set(got)) and set(got) == want
    # Segments are sent to few blocks instead of being joined square by square.
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    monkeypatch.setattr(MA, "PAIRS", 7)
    assert {tuple(r) for r in MA.segment_links(df.limit(60), 6, 3.0, 1.0).collect()} <= want


def test_small_graphs_need_no_rounds(spark):
    import glob

    from pagequarry.operators.components import graph_components
    from pagequarry.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    rng = random.Random(4)
    nodes = [(k, n * 7 - 300) for k in range(4) for n in range(100)] + [(None, 1), (None, 2), (1, None), (1, None), (2, 5), (2, 5)]
    edges = [(k, rng.randint(-1, 101) * 7 - 300, rng.randint(-1, 101) * 7 - 300) for k in range(4) for _ in range(60)] + [(0, -7, -293), (0, -7, -286), (None, 1, 2), (1, None, 0), (5, 1, 2)]
    edges += [(3, n * 7 - 300, n * 7 - 293) for n in range(0, 99)]
    want = {}
    for k in (0, 1, 2, 3):
        own = {n for j, n in nodes if j == k and n is not None}
        label = {n: n for n in own}
        for _ in own:
            for j, a, b in edges:
                if j == k and a in own and b in own:
                    label[a] = label[b] = min(label[a], label[b])
        want |= {(k, n): c for n, c in label.items()}
    want |= {(None, 1): 1, (None, 2): 2, (1, None): None}
    n, e = spark.createDataFrame(nodes, "k int, node int"), spark.createDataFrame(edges, "k int, a int, b int")
    for whole, tables in ((1 << 20, 1), (180, 3), (0, 3)):
        before = set(glob.glob(f"{folder}/components-*"))
        out = graph_components(n, e, ["k"], whole)
        rows = [tuple(r) for r in out.collect()]
        assert len(rows) == len(want) and {r[:2]: r[2] for r in rows} == want and out.schema["component"].dataType == n.schema["node"].dataType
        (made,) = set(glob.glob(f"{folder}/components-*")) - before
        found = len(glob.glob(f"{made}/*"))
        assert found == 1 if tables == 1 else found >= tables
