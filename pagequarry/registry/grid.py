"""Grid queries: neighbourhoods, components, regions, coverage and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..mappings import GRID_H as H
from ..mappings import GRID_W as W
from ..mappings import Tables
from ..operators import fusion as FU
from ..operators import grid as G
from ..operators import regions as R
from ..operators.components import grid_components
from . import query

PAGE = ["page_id"]
PAGE_W, PAGE_H = 1000, 800


# SQL pieces. Every mask is (page_id, y, x).
def sql_dilate(out: str, src: str, r: int = 1) -> str:
    return f"""{out} AS (SELECT DISTINCT page_id, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x FROM {src}, (SELECT unnest(range(-{r}, {r + 1})) AS dy), (SELECT unnest(range(-{r}, {r + 1})) AS dx)
        WHERE y + dy BETWEEN 0 AND {H - 1} AND x + dx BETWEEN 0 AND {W - 1})"""


def sql_erode(out: str, src: str, r: int = 1) -> str:
    return f"""{out} AS (SELECT a.page_id, a.y, a.x FROM {src} a JOIN {src} b ON a.page_id = b.page_id AND abs(a.y - b.y) <= {r} AND abs(a.x - b.x) <= {r}
        GROUP BY a.page_id, a.y, a.x HAVING count(*) = (least(a.y + {r}, {H - 1}) - greatest(a.y - {r}, 0) + 1) * (least(a.x + {r}, {W - 1}) - greatest(a.x - {r}, 0) + 1))"""


def sql_components(out: str, src: str) -> str:
    """Smallest raster position reachable over set neighbours."""
    return f"""{out}_reach AS (SELECT page_id, y, x, y * 4096 + x AS component FROM {src} UNION
        SELECT n.page_id, n.y, n.x, r.component FROM {out}_reach r JOIN {src} n ON n.page_id = r.page_id AND abs(n.y - r.y) <= 1 AND abs(n.x - r.x) <= 1 AND r.component < n.y * 4096 + n.x),
        {out} AS (SELECT page_id, y, x, CAST(min(component) AS BIGINT) AS component FROM {out}_reach GROUP BY page_id, y, x)"""


def sql_regions(src: str, min_area: float) -> str:
    """Region cells (``rc``) and statistics (``rs``) of the closed mask ``src``."""
    return ", ".join(
        [
            sql_dilate("cl_d", src), sql_erode("cl", "cl_d"), sql_components("comp", "cl"),
            f"rc AS (SELECT c.* FROM comp c JOIN (SELECT page_id, component FROM comp GROUP BY ALL HAVING count(*) / {W * H}.0 >= {min_area}) k ON k.page_id = c.page_id AND k.component = c.component)",
            f"""rs AS (SELECT page_id, component, count(*) AS pixels, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1,
            round_even(count(*) / {W * H}.0, 4) AS area,
            (['top-left', 'top', 'top-right', 'left', 'centre', 'right', 'bottom-left', 'bottom', 'bottom-right'])[CAST(least(2, floor((avg(y) + 0.5) / {H} * 3)) * 3 + least(2, floor((avg(x) + 0.5) / {W} * 3)) AS INTEGER) + 1] AS location,
            concat_ws(',', CASE WHEN min(y) <= 1 THEN 'top' END, CASE WHEN max(x) + 1 >= {W - 1} THEN 'right' END, CASE WHEN max(y) + 1 >= {H - 1} THEN 'bottom' END, CASE WHEN min(x) <= 1 THEN 'left' END) AS edges
            FROM rc GROUP BY page_id, component)""",
        ]
    )


COVER = "cover AS (SELECT page_id, y, x, count(DISTINCT shot) AS shots FROM cell GROUP BY ALL)"


def _cover(t: Tables):
    return R.coverage_count(G.checked(t.cell(), W, H), PAGE)


@query("coverage_counts", "D9", "cell", f"WITH {COVER} SELECT page_id, y, x, shots, shots = 1 AS single FROM cover")
def _(t: Tables):
    return _cover(t).withColumn("single", F.col("shots") == 1)


@query(
    "page_fractions", "D17 D9", "cell",
    f"""WITH {COVER} SELECT page_id, round(count(*) / {W * H}.0, 6) AS covered, round(1 - count(*) / {W * H}.0, 6) AS uncovered,
        round(count(*) FILTER (shots = 1) / count(*), 6) AS single FROM cover GROUP BY page_id""",
)
def _(t: Tables):
    f = FU.page_fractions(t.cell(), W * H)
    return f.select("page_id", *[F.round(c, 6).alias(c) for c in ("covered", "uncovered", "single")])


@query("mask_dilated", "H1 G2", "cell", f"WITH {COVER}, src AS (SELECT page_id, y, x FROM cover WHERE shots >= 3), {sql_dilate('d', 'src', 2)} SELECT * FROM d")
def _(t: Tables):
    return G.dilate(_cover(t).filter("shots >= 3"), PAGE, 2, W, H)


@query("mask_eroded", "H1", "cell", f"WITH {COVER}, {sql_erode('e', 'cover')} SELECT * FROM e")
def _(t: Tables):
    return G.erode(_cover(t), PAGE, 1, W, H)


@query("mask_opened", "H2", "cell", f"WITH {COVER}, {sql_erode('e', 'cover')}, {sql_dilate('o', 'e')} SELECT * FROM o")
def _(t: Tables):
    return G.opened(_cover(t), PAGE, 1, W, H)


@query("mask_closed", "H2", "cell", f"WITH {COVER}, src AS (SELECT page_id, y, x FROM cover WHERE shots = 1), {sql_dilate('d', 'src')}, {sql_erode('c', 'd')} SELECT * FROM c")
def _(t: Tables):
    return G.closed(_cover(t).filter("shots = 1"), PAGE, 1, W, H)


@query(
    "local_maximum", "H1", "cell",
    f"""SELECT page_id, shot, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x, max(g) AS top FROM cell, (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)
        WHERE y + dy BETWEEN 0 AND {H - 1} AND x + dx BETWEEN 0 AND {W - 1} GROUP BY ALL""",
)
def _(t: Tables):
    return G.local_max(t.cell(), ["page_id", "shot"], "g", 1, W, H, "top")


@query(
    "glare_halo", "H11", "cell",
    f"""SELECT page_id, shot, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x, max(g) AS top FROM cell, (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx)
        WHERE y + dy BETWEEN 0 AND {H - 1} AND x + dx BETWEEN 0 AND {W - 1} AND abs(dx) <= CASE abs(dy) WHEN 3 THEN 0 WHEN 2 THEN 2 ELSE 3 END GROUP BY ALL""",
)
def _(t: Tables):
    return G.local_max_disk(t.cell(), ["page_id", "shot"], "g", 3, W, H, "top")


@query(
    "local_mean_deviation", "H4", "cell",
    """SELECT a.page_id, a.shot, a.y, a.x, count(*) AS cells, round(avg(b.g), 6) AS mean, round(sqrt(greatest(avg(b.g * b.g) - avg(b.g) * avg(b.g), 0)), 4) AS deviation
       FROM cell a JOIN cell b ON a.page_id = b.page_id AND a.shot = b.shot AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL""",
)
def _(t: Tables):
    m = G.box_mean(t.cell(), ["page_id", "shot"], "g", 2, W, H)
    return m.select("page_id", "shot", "y", "x", F.col("cells").cast("bigint"), F.round("mean", 6).alias("mean"), F.round("deviation", 4).alias("deviation"))


@query(
    "smoothed_luminance", "H3", "cell",
    """WITH k AS (SELECT d, exp(-0.5 * (d / 1.5) ** 2) AS w FROM (SELECT unnest(range(-4, 5)) AS d)), n AS (SELECT d, w / (SELECT sum(w) FROM k) AS w FROM k)
       SELECT a.page_id, a.shot, a.y, a.x, round(sum(b.g * ky.w * kx.w) / greatest(sum(ky.w * kx.w), 1e-6), 5) AS smooth
       FROM cell a JOIN cell b ON a.page_id = b.page_id AND a.shot = b.shot JOIN n ky ON ky.d = b.y - a.y JOIN n kx ON kx.d = b.x - a.x GROUP BY ALL""",
)
def _(t: Tables):
    s = G.smoothed(t.cell(), ["page_id", "shot"], "g", 1.5, W, H, "smooth", reach=4)
    return s.select("page_id", "shot", "y", "x", F.round("smooth", 5).alias("smooth"))


@query(
    "grid_shrunk", "H5", "cell",
    f"""WITH {COVER} SELECT page_id, y // 3 AS y, x // 3 AS x, round(sum(shots) / (least(3, {H} - (y // 3) * 3) * least(3, {W} - (x // 3) * 3)), 6) AS mean,
        count(*) / (least(3, {H} - (y // 3) * 3) * least(3, {W} - (x // 3) * 3)) >= 0.5 AS mostly FROM cover GROUP BY page_id, y // 3, x // 3""",
)
def _(t: Tables):
    s = G.shrunk(_cover(t), PAGE, 3, W, H, mean=F.col("shots"), share=F.lit(1))
    return s.select("page_id", "y", "x", F.round("mean", 6).alias("mean"), (F.col("share") >= 0.5).alias("mostly"))


@query(
    "feather_distance", "H9", "cell",
    f"""WITH {COVER}, o AS (SELECT dy, dx FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx)),
        far AS (SELECT c.page_id, c.y, c.x, min(dy * dy + dx * dx) AS d2 FROM cover c, o WHERE NOT EXISTS (SELECT 1 FROM cover n WHERE n.page_id = c.page_id AND n.y = c.y + dy AND n.x = c.x + dx) GROUP BY ALL)
        SELECT c.page_id, c.y, c.x, round(sqrt(least(coalesce(d2, 9), 9)), 6) AS distance FROM cover c LEFT JOIN far f ON f.page_id = c.page_id AND f.y = c.y AND f.x = c.x""",
)
def _(t: Tables):
    return G.feather(_cover(t), PAGE, 3, W, H).withColumn("distance", F.round("distance", 6))


@query(
    "box_fill", "H14 G2", "",
    f"""WITH b AS (SELECT l_suppkey AS page_id, l_discount * 5 AS x0, l_tax * 5 AS y0, l_discount * 5 + l_quantity / 200 AS x1, l_tax * 5 + l_quantity / 250 AS y1 FROM lineitem)
        SELECT DISTINCT page_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM b,
          LATERAL (SELECT unnest(range(CAST(greatest(floor(y0 * {H}), 0) AS BIGINT), CAST(least(ceil(y1 * {H}), {H}) AS BIGINT))) AS y), LATERAL (SELECT unnest(range(CAST(greatest(floor(x0 * {W}), 0) AS BIGINT), CAST(least(ceil(x1 * {W}), {W}) AS BIGINT))) AS x)""",
)
def _(t: Tables):
    b = t.raw("lineitem").select(
        F.col("l_suppkey").alias("page_id"), (F.col("l_discount") * 5).alias("x0"), (F.col("l_tax") * 5).alias("y0"),
        (F.col("l_discount") * 5 + F.col("l_quantity") / 200).alias("x1"), (F.col("l_tax") * 5 + F.col("l_quantity") / 250).alias("y1"),
    )
    return G.box_fill(b, W, H, once=True)


@query(
    "run_adjacency", "C17", "cell",
    f"""WITH {COVER}, isl AS (SELECT page_id, y, x, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS i FROM cover WHERE shots = 1),
        runs AS (SELECT page_id, y, min(x) AS x0, max(x) AS x1 FROM isl GROUP BY page_id, y, i)
        SELECT a.page_id, a.y, a.x0, a.x1, b.x0 AS below_x0, b.x1 AS below_x1 FROM runs a JOIN runs b ON b.page_id = a.page_id AND b.y = a.y + 1 AND a.x0 <= b.x1 + 1 AND a.x1 >= b.x0 - 1""",
)
def _(t: Tables):
    return G.run_adjacency(G.row_runs(_cover(t).filter("shots = 1"), PAGE), PAGE)


@query("connected_components", "H6", "cell", f"WITH RECURSIVE {COVER}, src AS (SELECT page_id, y, x FROM cover WHERE shots = 1), {sql_components('comp', 'src')} SELECT * FROM comp")
def _(t: Tables):
    return grid_components(_cover(t).filter("shots = 1"), PAGE).drop("pixels")


@query(
    "hysteresis_areas", "H7", "cell",
    f"""WITH RECURSIVE s AS (SELECT page_id, y, x, max(score) AS v FROM cell GROUP BY ALL), weak AS (SELECT page_id, y, x FROM s WHERE v >= 55), seed AS (SELECT page_id, y, x FROM s WHERE v >= 95),
        {sql_components('comp', 'weak')} SELECT page_id, y, x FROM comp c WHERE (page_id, component) IN (SELECT (c2.page_id, c2.component) FROM comp c2 JOIN seed d ON d.page_id = c2.page_id AND d.y = c2.y AND d.x = c2.x)""",
)
def _(t: Tables):
    s = t.cell().groupBy("page_id", "y", "x").agg(F.max("score").alias("v"))
    return R.hysteresis(s, PAGE, "v", 95, 55, 1, W, H)


@query(
    "hysteresis_wide_seeds", "H7 H2", "cell",
    f"""WITH RECURSIVE s AS (SELECT page_id, y, x, max(score) AS v FROM cell GROUP BY ALL), hot AS (SELECT page_id, y, x FROM s WHERE v >= 45), {sql_erode('core', 'hot')}, {sql_dilate('seed', 'core')},
        weak AS (SELECT page_id, y, x FROM s WHERE v >= 40), {sql_components('comp', 'weak')} SELECT page_id, y, x FROM comp c WHERE (page_id, component) IN (SELECT (c2.page_id, c2.component) FROM comp c2 JOIN seed d ON d.page_id = c2.page_id AND d.y = c2.y AND d.x = c2.x)""",
)
def _(t: Tables):
    # Seeds at least three cells wide.
    s = t.cell().groupBy("page_id", "y", "x").agg(F.max("score").alias("v"))
    return R.hysteresis(s, PAGE, "v", 45, 40, 3, W, H)


@query(
    "grid_resized", "H5", "cell",
    f"""WITH c AS (SELECT page_id, y, x, count(*) AS shots FROM cell GROUP BY ALL), k AS (SELECT unnest(range(10)) AS i), l AS (SELECT unnest(range(8)) AS j),
       o AS (SELECT page_id, i, j, sum(shots * (least((x + 1) * 10, (i + 1) * {W}) - greatest(x * 10, i * {W})) * (least((y + 1) * 8, (j + 1) * {H}) - greatest(y * 8, j * {H}))) AS s
             FROM c JOIN k ON x * 10 < (i + 1) * {W} AND (x + 1) * 10 > i * {W} JOIN l ON y * 8 < (j + 1) * {H} AND (y + 1) * 8 > j * {H} GROUP BY ALL)
       SELECT page_id, CAST(j AS INTEGER) AS y, CAST(i AS INTEGER) AS x, CAST(s AS DOUBLE) / {W * H} AS mean FROM o""",
)
def _(t: Tables):
    # Two and a half cells become one, each way.
    c = t.cell().groupBy("page_id", "y", "x").agg(F.count(F.lit(1)).alias("shots"))
    return G.resized(c, PAGE, 10, 8, W, H, mean=F.col("shots"))


@query(
    "uncovered_regions", "D21 E9 B11", "cell",
    f"""WITH RECURSIVE {COVER}, src AS (SELECT p.page_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM (SELECT DISTINCT page_id FROM cell) p, (SELECT unnest(range({H})) AS y), (SELECT unnest(range({W})) AS x)
         WHERE (page_id, y, x) NOT IN (SELECT (page_id, y, x) FROM cover)), {sql_regions('src', 0.004)}
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pixels DESC, y0, x0, component) AS ord, pixels, round_even(x0 / {W}, 4) AS fx0, round_even(y0 / {H}, 4) AS fy0, round_even(x1 / {W}, 4) AS fx1, round_even(y1 / {H}, 4) AS fy1,
        CAST(x0 * {PAGE_W // W} AS BIGINT) AS px0, CAST(y0 * {PAGE_H // H} AS BIGINT) AS py0, CAST(x1 * {PAGE_W // W} AS BIGINT) AS px1, CAST(y1 * {PAGE_H // H} AS BIGINT) AS py1, area, location, edges FROM rs""",
)
def _(t: Tables):
    cells = t.cell()
    src = R.uncovered_mask(_cover(t), PAGE, 1, W, H, cells)
    s = R.region_stats(R.region_cells(src, PAGE, W, H, 0.004), PAGE, W, H, PAGE_W, PAGE_H)
    return s.select("page_id", F.col("ord").cast("bigint"), "pixels", "fx0", "fy0", "fx1", "fy1", *[F.col(c).cast("bigint") for c in ("px0", "py0", "px1", "py1")], "area", "location", F.concat_ws(",", "edges").alias("edges"))


# In 128ths, so that means are exact in any order.
RESIDUAL = "res AS (SELECT page_id, y, x, max(score) / 128.0::DOUBLE AS residual FROM cell GROUP BY ALL)"


def _residual(t: Tables):
    return t.cell().groupBy("page_id", "y", "x").agg((F.max("score") / 128).alias("residual"))


@query(
    "glare_regions", "D22 D21", "cell",
    f"""WITH RECURSIVE {COVER}, {RESIDUAL}, src AS (SELECT page_id, y, x FROM res WHERE residual >= 0.625), {sql_regions('src', 0.004)},
        why AS (SELECT rc.page_id, rc.component, count(*) FILTER (shots = 1) > 0.5 * count(*) AS single, avg(coalesce(residual, 0)) AS sev FROM rc LEFT JOIN cover c ON c.page_id = rc.page_id AND c.y = rc.y AND c.x = rc.x
          LEFT JOIN res r ON r.page_id = rc.page_id AND r.y = rc.y AND r.x = rc.x GROUP BY ALL),
        who AS (SELECT page_id, component, string_agg(CAST(shot AS VARCHAR), ',' ORDER BY shot) AS seen_by FROM (SELECT DISTINCT rc.page_id, rc.component, c.shot FROM rc JOIN cell c ON c.page_id = rc.page_id AND c.y = rc.y AND c.x = rc.x) GROUP BY ALL)
        SELECT rs.page_id, rs.component, pixels, location, CASE WHEN single THEN 'single_shot' ELSE 'all_shots_glared' END AS cause, round_even(sev, 4) AS severity, coalesce(seen_by, '') AS seen_by
        FROM rs JOIN why ON why.page_id = rs.page_id AND why.component = rs.component LEFT JOIN who ON who.page_id = rs.page_id AND who.component = rs.component""",
)
def _(t: Tables):
    g = R.glare_regions(_residual(t), t.cell(), PAGE, W, H, PAGE_W, PAGE_H, threshold=0.625, min_area=0.004)
    return g.select("page_id", "component", "pixels", "location", "cause", "severity", F.concat_ws(",", F.transform("shots", lambda s: s.cast("string"))).alias("seen_by"))


@query(
    "single_coverage_regions", "D23 H2", "cell",
    f"""WITH RECURSIVE {COVER}, one AS (SELECT page_id, y, x FROM cover WHERE shots = 1), {sql_erode('op_e', 'one')}, {sql_dilate('src', 'op_e')}, {RESIDUAL}, {sql_regions('src', 0.01)},
        own AS (SELECT page_id, component, shot FROM (SELECT rc.page_id, rc.component, c.shot, row_number() OVER (PARTITION BY rc.page_id, rc.component ORDER BY count(*) DESC, c.shot) AS n
          FROM rc JOIN cell c ON c.page_id = rc.page_id AND c.y = rc.y AND c.x = rc.x GROUP BY rc.page_id, rc.component, c.shot) WHERE n = 1),
        seen AS (SELECT rc.page_id, rc.component, round_even(count(r.page_id) / count(*), 4) AS glare_seen FROM rc LEFT JOIN (SELECT * FROM res WHERE residual >= 0.5) r ON r.page_id = rc.page_id AND r.y = rc.y AND r.x = rc.x GROUP BY ALL)
        SELECT rs.page_id, rs.component, pixels, area, location, edges, own.shot, glare_seen FROM rs JOIN own ON own.page_id = rs.page_id AND own.component = rs.component JOIN seen ON seen.page_id = rs.page_id AND seen.component = rs.component""",
)
def _(t: Tables):
    s = R.single_regions(t.cell(), PAGE, W, H, PAGE_W, PAGE_H, _residual(t))
    return s.select("page_id", "component", "pixels", "area", "location", F.concat_ws(",", "edges").alias("edges"), "shot", "glare_seen")


@query(
    "low_percentiles", "D10 D11", "cell",
    """WITH l AS (SELECT page_id, y, x, list_sort(list(g)) AS v FROM cell GROUP BY ALL)
       SELECT page_id, y, x, len(v) AS shots, v[1 + CAST(floor(0.25 * (len(v) - 1)) AS INTEGER)] AS low, v[1 + (len(v) - 1) // 2] AS middle FROM l""",
)
def _(t: Tables):
    c = t.cell()
    low = FU.low_percentile(c, "g", 25, "low")
    return low.join(FU.low_percentile(c, "g", 50, "middle").drop("shots"), FU.CELL).withColumn("shots", F.col("shots").cast("bigint"))


@query("excess_over_darkest", "D12", "cell", "SELECT page_id, shot, y, x, g - min(g) OVER (PARTITION BY page_id, y, x) AS excess FROM cell")
def _(t: Tables):
    return FU.excess_over_darkest(t.cell(), "g").select("page_id", "shot", "y", "x", "excess")


@query(
    "leave_one_out_reference", "C20", "cell",
    """WITH n AS (SELECT *, count(*) OVER w AS c, sum(g) OVER w AS s, list_sort(list(g) OVER w) AS v FROM cell WINDOW w AS (PARTITION BY page_id, y, x))
       SELECT page_id, shot, y, x, c - 1 AS others, CAST(CASE WHEN c = 2 THEN s - g WHEN c > 2 THEN v[1 + (c - 1) // 2] END AS VARCHAR) AS reference FROM n""",
)
def _(t: Tables):
    r = FU.leave_one_out(t.cell(), "g")
    return r.select("page_id", "shot", "y", "x", "others", F.col("reference").cast("string"))


@query(
    "shot_weights", "D14 H9 H11", "cell",
    f"""WITH ex AS (SELECT *, (g - min(g) OVER (PARTITION BY page_id, y, x)) / 1000.0 AS excess FROM cell),
        wide AS (SELECT a.page_id, a.shot, a.y, a.x, max(b.excess) AS e FROM ex a JOIN ex b ON a.page_id = b.page_id AND a.shot = b.shot AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY ALL),
        o AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)),
        far AS (SELECT c.page_id, c.shot, c.y, c.x, min(dy * dy + dx * dx) AS d2 FROM cell c, o WHERE NOT EXISTS (SELECT 1 FROM cell n WHERE n.page_id = c.page_id AND n.shot = c.shot AND n.y = c.y + dy AND n.x = c.x + dx) GROUP BY ALL)
        SELECT w.page_id, w.shot, w.y, w.x, round(pow(least(greatest(sqrt(least(coalesce(d2, 4), 4)) / 2, 1e-3), 1) * exp(-greatest(e - 0.02, 0) / 0.03), 2) + 1e-8, 8) AS weight
        FROM wide w LEFT JOIN far f ON f.page_id = w.page_id AND f.shot = w.shot AND f.y = w.y AND f.x = w.x""",
)
def _(t: Tables):
    ex = FU.excess_over_darkest(t.cell(), "g").withColumn("excess", F.col("excess") / 1000)
    return FU.weights(ex, W, H, reach=2, halo=1).select("page_id", "shot", "y", "x", F.round("weight", 8).alias("weight"))


@query("fused_page", "D13", "cell", "SELECT page_id, y, x, round(sum((score + 1) * b) / sum(score + 1), 6) AS b, round(sum((score + 1) * g) / sum(score + 1), 6) AS g, round(sum((score + 1) * r) / sum(score + 1), 6) AS r FROM cell GROUP BY page_id, y, x")
def _(t: Tables):
    f = FU.fused(t.cell().withColumn("weight", F.col("score") + 1), "weight", "b", "g", "r")
    return f.select("page_id", "y", "x", *[F.round(c, 6).alias(c) for c in "bgr"])


@query(
    "smoothed_weight_shares", "D15 H3", "cell",
    """WITH k AS (SELECT d, exp(-0.5 * d ** 2) AS w FROM (SELECT unnest(range(-3, 4)) AS d)), n AS (SELECT d, w / (SELECT sum(w) FROM k) AS w FROM k),
       s AS (SELECT page_id, shot, y, x, (score + 1) / sum(score + 1) OVER (PARTITION BY page_id, y, x) AS share FROM cell)
       SELECT a.page_id, a.shot, a.y, a.x, round(sum(b.share * ky.w * kx.w) / sum(ky.w * kx.w) + 1e-8, 6) AS weight FROM s a JOIN s b ON a.page_id = b.page_id AND a.shot = b.shot
       JOIN n ky ON ky.d = b.y - a.y JOIN n kx ON kx.d = b.x - a.x GROUP BY ALL""",
)
def _(t: Tables):
    s = FU.smoothed_shares(t.cell().withColumn("weight", (F.col("score") + 1).cast("double")), 1.0, W, H)
    return s.select("page_id", "shot", "y", "x", F.round("weight", 6).alias("weight"))


@query(
    "residual_glare", "D16 I4", "cell",
    """WITH ex AS (SELECT *, (g - min(g) OVER (PARTITION BY page_id, y, x)) / 255.0 AS excess FROM cell),
       gl AS (SELECT *, greatest(CASE WHEN score >= 70 THEN score / 100 ELSE 0 END, CASE WHEN score >= 30 THEN least(excess / 0.08, 1) ELSE 0 END) AS glare FROM ex)
       SELECT page_id, y, x, round(sum((r + 1) * glare) / sum(r + 1), 6) AS residual FROM gl GROUP BY page_id, y, x""",
)
def _(t: Tables):
    ex = FU.excess_over_darkest(t.cell(), "g").withColumn("excess", F.col("excess") / 255)
    score = F.col("score") / 100
    gl = ex.withColumn("glare", FU.combined_glare(F.when(score >= 0.7, score).otherwise(0.0), score, F.col("excess"), 0.3)).withColumn("weight", F.col("r") + 1)
    return FU.residual(gl, "weight", "glare").withColumn("residual", F.round("residual", 6))


@query("shot_glare_shares", "D17", "cell", "SELECT page_id, shot, round(count(*) FILTER (score >= 50) / count(*), 6) AS glare FROM cell GROUP BY page_id, shot")
def _(t: Tables):
    return FU.shot_shares(t.cell(), "score", 50, "glare").withColumn("glare", F.round("glare", 6))


@query(
    "tone_reference", "D18", "cell",
    """WITH s AS (SELECT page_id, shot, count(*) FILTER (greatest(b, g, r) >= 250) / count(*) AS clipped, sum(b + g + r) / (3 * count(*)) AS bright FROM cell GROUP BY ALL),
       ok AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY bright, shot) - 1 AS r, count(*) OVER (PARTITION BY page_id) AS n FROM (SELECT *, min(clipped) OVER (PARTITION BY page_id) AS least FROM s) WHERE clipped <= least + 0.02)
       SELECT page_id, shot, round(clipped, 6) AS clipped, round(bright, 4) AS bright FROM ok WHERE r = n // 2""",
)
def _(t: Tables):
    return FU.tone_reference(t.cell()).select("page_id", "shot", F.round("clipped", 6).alias("clipped"), F.round("bright", 4).alias("bright"))


@query(
    "cell_layers", "C16", "cell",
    f"""WITH {COVER}, m AS (SELECT page_id, y, x, min(g) AS darkest FROM cell GROUP BY ALL)
        SELECT c.page_id, c.shot, c.y, c.x, k.shots, g - darkest AS excess, d.s_acctbal > 0 AS truth FROM cell c JOIN cover k ON k.page_id = c.page_id AND k.y = c.y AND k.x = c.x
        JOIN m ON m.page_id = c.page_id AND m.y = c.y AND m.x = c.x JOIN supplier d ON d.s_suppkey = c.page_id""",
)
def _(t: Tables):
    truth = t.raw("supplier").select(F.col("s_suppkey").alias("page_id"), (F.col("s_acctbal") > 0).alias("truth"))
    layers = FU.coverage_counted(FU.excess_over_darkest(t.cell(), "g")).join(truth, "page_id")
    return layers.select("page_id", "shot", "y", "x", "shots", "excess", "truth")
