"""Queries on light: glare features, shadows, labels and tone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import photometry as P
from ..mappings import GRID_H as H
from ..mappings import GRID_W as W
from ..mappings import Tables
from ..operators import fusion as FU
from ..operators import glare as GL
from ..operators import labels as LB
from ..operators import regions as R
from ..operators import shadow as SH
from ..operators import tone as TN
from . import query
from .grid import sql_components, sql_dilate, sql_erode

AT = ["page_id", "shot", "y", "x"]
def _bgr():
    return [F.col(c) for c in "bgr"]



def lin(c: str) -> str:
    return f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"


@query(
    "cell_light", "B25 B26", "cell",
    f"""WITH l AS (SELECT page_id, shot, y, x, b, g, r, {lin('b')} AS lb, {lin('g')} AS lg, {lin('r')} AS lr FROM cell),
        t AS (SELECT *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 AS tx, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb AS ty, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 AS tz FROM l),
        f AS (SELECT *, CASE WHEN tx > 0.008856 THEN pow(tx, 1 / 3.0) ELSE tx * 7.787 + 16 / 116.0 END AS fx, CASE WHEN ty > 0.008856 THEN pow(ty, 1 / 3.0) ELSE ty * 7.787 + 16 / 116.0 END AS fy,
          CASE WHEN tz > 0.008856 THEN pow(tz, 1 / 3.0) ELSE tz * 7.787 + 16 / 116.0 END AS fz FROM t)
        SELECT page_id, shot, y, x, round(lb * 0.0722 + lg * 0.7152 + lr * 0.2126, 6) AS luminance, least(b, g, r) AS darkest,
          round(sqrt(pow((fx - fy) * 500, 2) + pow((fy - fz) * 200, 2)), 3) AS chroma, round((CAST(b >= 250 AS INTEGER) + CAST(g >= 250 AS INTEGER) + CAST(r >= 250 AS INTEGER)) / 3.0, 6) AS clipped FROM f""",
)
def _(t: Tables):
    return t.cell().select(
        *AT, F.round(P.luminance(*[P.linear(c) for c in _bgr()]), 6).alias("luminance"), P.darkest(*_bgr()).alias("darkest"),
        F.round(P.chroma(*_bgr()), 3).alias("chroma"), F.round(P.clipped_share(*_bgr()), 6).alias("clipped"),
    )


@query("glare_scores", "B27", "cell", "SELECT page_id, shot, y, x, round(1 / (1 + exp(-(7.5 * (b / 255.0) + (1 - g / 255.0) + 2.32 * (score / 100.0) - 4.13))), 8) AS score FROM cell")
def _(t: Tables):
    s = P.glare_score(F.col("b") / 255, 1 - F.col("g") / 255, F.col("r") / 255, F.col("score") / 100)
    return t.cell().select(*AT, F.round(s, 8).alias("score"))


@query(
    "local_background", "H8", "cell",
    f"""WITH k AS (SELECT d, exp(-0.5 * (d / 3.0) ** 2) AS w FROM (SELECT unnest(range(-9, 10)) AS d)), n AS (SELECT d, w / (SELECT sum(w) FROM k) AS w FROM k),
        gx AS (SELECT page_id, shot, y, x + d AS x, sum(g * w) AS s, sum(w) AS m FROM cell, n WHERE x + d BETWEEN 0 AND {W - 1} GROUP BY ALL),
        gy AS (SELECT page_id, shot, y + d AS y, x, sum(s * w) AS s, sum(m * w) AS m FROM gx, n WHERE y + d BETWEEN 0 AND {H - 1} GROUP BY ALL),
        far AS (SELECT page_id, shot, median(g) AS far FROM cell GROUP BY ALL),
        full_grid AS (SELECT f.page_id, f.shot, yy.y, xx.x, coalesce(c.g, CASE WHEN gy.m > 1e-3 THEN gy.s / gy.m END, f.far) AS v FROM far f CROSS JOIN (SELECT unnest(range({H})) AS y) yy CROSS JOIN (SELECT unnest(range({W})) AS x) xx
          LEFT JOIN cell c ON c.page_id = f.page_id AND c.shot = f.shot AND c.y = yy.y AND c.x = xx.x LEFT JOIN gy ON gy.page_id = f.page_id AND gy.shot = f.shot AND gy.y = yy.y AND gy.x = xx.x),
        q AS (SELECT page_id, shot, y, x, CAST(floor(least(greatest(v + 0.5, 0), 255)) AS INTEGER) AS q FROM full_grid),
        near AS (SELECT c.page_id, c.shot, c.y, c.x, list_sort(list(q.q)) AS v FROM cell c JOIN q ON q.page_id = c.page_id AND q.shot = c.shot AND abs(q.y - c.y) <= 1 AND abs(q.x - c.x) <= 1 GROUP BY ALL)
        SELECT page_id, shot, y, x, CAST(v[1 + len(v) // 2] AS DOUBLE) AS background FROM near""",
)
def _(t: Tables):
    return GL.background(t.cell(), W, H, background=("g", 1.0)).select(*AT, "background")


@query("single_photo_glare", "I3 K4", "")
def _(t: Tables):
    d = GL.detect(t.cell(), W, H, min_seed=1, seed=0.35, weak=0.1)
    return d.select(*AT, *[F.round(c, 5).alias(c) for c in ("veil", "desat", "flat", "clip", "score", "glare")])


@query("detector_glare", "I3 K4 H7", "cell",
    f"""WITH RECURSIVE one AS (SELECT page_id * 8 + shot AS page_id, y, x, b / 255.0 AS s FROM cell), weak AS (SELECT page_id, y, x FROM one WHERE s >= 0.3), {sql_components('comp', 'weak')},
        keep AS (SELECT DISTINCT c.page_id, c.component FROM comp c JOIN one o ON o.page_id = c.page_id AND o.y = c.y AND o.x = c.x AND o.s >= 0.9),
        kept AS (SELECT c.page_id, c.y, c.x FROM comp c JOIN keep k ON k.page_id = c.page_id AND k.component = c.component)
        SELECT o.page_id // 8 AS page_id, CAST(o.page_id % 8 AS INTEGER) AS shot, o.y, o.x, round(CASE WHEN k.page_id IS NULL THEN 0 ELSE s END, 6) AS glare FROM one o LEFT JOIN kept k ON k.page_id = o.page_id AND k.y = o.y AND k.x = o.x""",
)
def _(t: Tables):
    d = GL.detect(t.cell().withColumn("net_score", F.col("b") / 255), W, H, "net", seed=0.9, weak=0.3, min_seed=1)
    return d.select(*AT, F.round("glare", 6).alias("glare"))


@query(
    "adapted_bias", "I5", "cell",
    """WITH c AS (SELECT *, count(*) OVER w AS n, (g - min(g) OVER w) / 255.0 AS excess, 7.5 * (score / 100.0) AS z FROM cell WINDOW w AS (PARTITION BY page_id, y, x)),
       l AS (SELECT page_id, shot, y, x, z, CASE WHEN excess > 0.08 THEN 1 ELSE 0 END AS label FROM c WHERE n >= 2 AND (excess > 0.08 OR excess < 0.02)),
       e AS (SELECT page_id FROM l GROUP BY page_id HAVING count(*) >= 100 AND count(*) FILTER (label = 1) >= 20 AND count(*) FILTER (label = 0) > 0),
       k AS (SELECT unnest(range(61)) AS k), t AS (SELECT page_id, label, k, -4.13 - 1.5 + k * (3.0 / 60) AS b, z FROM l JOIN e USING (page_id), k),
       s AS (SELECT page_id, k, b, avg(CASE WHEN label = 1 THEN greatest(-(b + z), 0) + ln(1 + exp(-abs(b + z))) END) + 30 * avg(CASE WHEN label = 0 THEN greatest(b + z, 0) + ln(1 + exp(-abs(b + z))) END) AS loss FROM t GROUP BY ALL),
       m AS (SELECT page_id, b FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(loss, 12), k) AS n FROM s) WHERE n = 1)
       SELECT p.page_id, round(coalesce(m.b, -4.13), 6) AS bias, m.b IS NOT NULL AS adapted FROM (SELECT DISTINCT page_id FROM cell) p LEFT JOIN m ON m.page_id = p.page_id""",
)
def _(t: Tables):
    c = FU.excess_over_darkest(t.cell(), "g").withColumn("excess", F.col("excess") / 255).withColumn("z", F.col("score") / 100 * 7.5)
    b = GL.adapted_bias(c, min_labels=100, min_glare=20)
    return b.select("page_id", F.round("bias", 6).alias("bias"), "adapted")


FIT = (
    "li AS (SELECT page_id, shot, y, x, " + ", ".join(f"{lin(c)} AS i_{c}" for c in "bgr") + " FROM cell), "
    "ls AS (SELECT *, count(*) OVER w - 1 AS others, " + ", ".join(f"list_sort(list(i_{c}) OVER w) AS v_{c}" for c in "bgr") + " FROM li WINDOW w AS (PARTITION BY page_id, y, x)), "
    "pr AS (SELECT page_id, shot, y, x, others, i_b, i_g, i_r, "
    + ", ".join(f"CASE WHEN others = 1 THEN CASE WHEN v_{c}[1] = i_{c} THEN v_{c}[2] ELSE v_{c}[1] END ELSE v_{c}[1 + others // 2] END AS q_{c}" for c in "bgr")
    + " FROM ls WHERE others > 0), "
    "su AS (SELECT a.page_id, a.shot, a.y, a.x, " + ", ".join(
        f"avg(n.i_{c}) AS mi_{c}, avg(n.q_{c}) AS mq_{c}, avg(n.i_{c} * n.i_{c}) AS ii_{c}, avg(n.q_{c} * n.q_{c}) AS qq_{c}, avg(n.i_{c} * n.q_{c}) AS iq_{c}" for c in "bgr"
    ) + " FROM pr a JOIN pr n ON n.page_id = a.page_id AND n.shot = a.shot AND abs(n.y - a.y) <= 1 AND abs(n.x - a.x) <= 1 GROUP BY ALL), "
    "va AS (SELECT *, greatest(" + " + ".join(f"(ii_{c} - mi_{c} * mi_{c})" for c in "bgr") + ", 0) AS var_i, greatest(" + " + ".join(f"(qq_{c} - mq_{c} * mq_{c})" for c in "bgr")
    + ", 0) AS var_q, " + " + ".join(f"(iq_{c} - mi_{c} * mq_{c})" for c in "bgr") + " AS cov, (mi_b + mi_g + mi_r) / 3 AS mean_i, (mq_b + mq_g + mq_r) / 3 AS mean_q FROM su), "
    "ft AS (SELECT *, CASE WHEN cov > 1e-12 THEN sqrt(var_q / greatest(var_i, 1e-6)) ELSE 0 END AS a FROM va)"
)
CUES = FIT + """, yy AS (SELECT *, mean_q - a * mean_i AS b, mi_b * 0.0722 + mi_g * 0.7152 + mi_r * 0.2126 AS yi, mq_b * 0.0722 + mq_g * 0.7152 + mq_r * 0.2126 AS yq FROM ft),
    zz AS (SELECT *, 1 - yi / greatest(yq, 1e-6) AS depth, {spread} AS spread, {expected} AS expected FROM yy),
    mm AS (SELECT *, CASE WHEN yi < 0.08 THEN 0 WHEN expected >= 0.15 THEN least(greatest(1 - spread / greatest(0.5 * expected, 1e-6), 0), 1)
      WHEN cov > 1e-12 AND cov >= 0.6 * sqrt(var_i * var_q) THEN least(greatest(1 - abs(b) / (0.12 * greatest(mean_q, 1e-6)), 0), 1) ELSE 0 END AS m FROM zz),
    cu AS (SELECT page_id, shot, y, x, depth, least(greatest((depth - 0.12) / 0.1, 0), 1) * m AS cue, least(greatest((depth - 0.04) / 0.1, 0), 1) * m AS cue_grow FROM mm)""".replace(
    "{spread}", "greatest({0}) - least({0})".format(", ".join(f"ln(greatest(mq_{c}, 1e-6)) - ln(greatest(mi_{c}, 1e-6))" for c in "bgr"))
).replace("{expected}", "greatest({0}) - least({0})".format(", ".join(f"ln(1 + greatest(yq - yi, 0) / greatest(mi_{c}, 1e-6))" for c in "bgr")))


@query("window_texture_fit", "H10 C20", "cell", "WITH " + FIT + " SELECT page_id, shot, y, x, round(a, 4) AS a, round(mean_q - a * mean_i, 4) + 0 AS b, round(mean_q, 5) AS mean_q FROM ft")
def _(t: Tables):
    f = SH.window_fit(SH.with_references(t.cell()), 1, W, H)
    return f.select(*AT, F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round("mean_q", 5).alias("mean_q"))


@query("shadow_cues", "I6", "cell", "WITH " + CUES + " SELECT page_id, shot, y, x, round(depth, 5) AS depth, round(cue, 4) AS cue, round(cue_grow, 4) AS cue_grow FROM cu")
def _(t: Tables):
    c = SH.cues(SH.window_fit(SH.with_references(t.cell()), 1, W, H))
    return c.select(*AT, *[F.round(n, d).alias(n) for n, d in (("depth", 5), ("cue", 4), ("cue_grow", 4))])


@query(
    "comparison_shadow", "I6 H7", "cell",
    "WITH RECURSIVE " + CUES + f""", weak AS (SELECT DISTINCT page_id * 8 + shot AS page_id, y, x FROM cu WHERE cue_grow >= 0.3 OR cue >= 0.7), {sql_components('comp', 'weak')},
      keep AS (SELECT c.page_id, c.component FROM comp c LEFT JOIN cu ON cu.page_id * 8 + cu.shot = c.page_id AND cu.y = c.y AND cu.x = c.x GROUP BY ALL HAVING count(*) >= 0.002 * {W * H} AND max(cu.cue) >= 0.7)
      SELECT c.page_id // 8 AS page_id, CAST(c.page_id % 8 AS INTEGER) AS shot, c.y, c.x, round(greatest(cu.cue, cu.cue_grow), 4) AS value FROM comp c JOIN keep k ON k.page_id = c.page_id AND k.component = c.component
      JOIN cu ON cu.page_id * 8 + cu.shot = c.page_id AND cu.y = c.y AND cu.x = c.x""",
)
def _(t: Tables):
    return SH.comparison_shadow(t.cell(), W, H, min_seed=1).select(*AT, F.round("value", 4).alias("value"))


# With the glare veto: the other side's score, the largest within the reach (one cell here) of each place.
VETOED = CUES.replace("FROM zz),", "FROM zzv),").replace("WHEN cov > 1e-12 AND cov >=", "WHEN veto >= 0.3 THEN 0 WHEN cov > 1e-12 AND cov >=").replace(
    "    mm AS (", f"""    gw AS (SELECT page_id, shot, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x, max(score) / 100.0::DOUBLE AS wide FROM cell, (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)
      WHERE abs(dy) + abs(dx) <= 1 AND y + dy BETWEEN 0 AND {H - 1} AND x + dx BETWEEN 0 AND {W - 1} GROUP BY ALL),
    gc AS (SELECT *, list_sort(list(wide) OVER w) AS v FROM gw SEMI JOIN cell USING (page_id, shot, y, x) WINDOW w AS (PARTITION BY page_id, y, x)),
    gv AS (SELECT page_id, shot, y, x, CASE WHEN len(v) = 2 THEN CASE WHEN v[1] = wide THEN v[2] ELSE v[1] END ELSE (v[1 + (len(v) - 1) // 2] + v[1 + len(v) // 2]) / 2 END AS veto FROM gc),
    zzv AS (SELECT zz.*, coalesce(gv.veto, 0) AS veto FROM zz LEFT JOIN gv USING (page_id, shot, y, x)), mm AS (""",
).replace("SELECT page_id, shot, y, x, depth, least(greatest((depth - 0.12) / 0.1, 0), 1) * m AS cue, least(greatest((depth - 0.04) / 0.1, 0), 1) * m AS cue_grow", "SELECT page_id, shot, y, x, depth, least(greatest((depth - 0.12) / 0.1, 0), 1) * m * (1 - least(greatest(veto, 0), 1)) AS cue, least(greatest((depth - 0.04) / 0.1, 0), 1) * m * (1 - least(greatest(veto, 0), 1)) AS cue_grow")


@query(
    "vetoed_shadow", "I6 H11", "cell",
    "WITH RECURSIVE " + VETOED + f""", weak AS (SELECT DISTINCT page_id * 8 + shot AS page_id, y, x FROM cu WHERE cue_grow >= 0.3 OR cue >= 0.7), {sql_components('comp', 'weak')},
      keep AS (SELECT c.page_id, c.component FROM comp c LEFT JOIN cu ON cu.page_id * 8 + cu.shot = c.page_id AND cu.y = c.y AND cu.x = c.x GROUP BY ALL HAVING count(*) >= 0.002 * {W * H} AND max(cu.cue) >= 0.7)
      SELECT c.page_id // 8 AS page_id, CAST(c.page_id % 8 AS INTEGER) AS shot, c.y, c.x, round(greatest(cu.cue, cu.cue_grow), 4) AS value FROM comp c JOIN keep k ON k.page_id = c.page_id AND k.component = c.component
      JOIN cu ON cu.page_id * 8 + cu.shot = c.page_id AND cu.y = c.y AND cu.x = c.x""",
)
def _(t: Tables):
    cells = t.cell()
    glare = cells.select(*AT, (F.col("score") / 100).alias("score"))
    return SH.comparison_shadow(cells, W, H, glare=glare, min_seed=1).select(*AT, F.round("value", 4).alias("value"))


@query(
    "reported_shadow", "I7", "cell",
    f"""WITH RECURSIVE n AS (SELECT page_id * 8 + shot AS page_id, y, x, score, b, count(*) OVER (PARTITION BY page_id, y, x) AS c FROM cell),
        seed AS (SELECT page_id, y, x FROM n WHERE b >= 230 AND c >= 2), weak AS (SELECT page_id, y, x FROM n WHERE (score >= 30 AND c = 1) OR (b >= 230 AND c >= 2)), {sql_components('ca', 'weak')},
        beyond AS (SELECT page_id, y, x FROM ca WHERE (page_id, component) IN (SELECT (c.page_id, c.component) FROM ca c JOIN seed s ON s.page_id = c.page_id AND s.y = c.y AND s.x = c.x) AND (page_id, y, x) NOT IN (SELECT (page_id, y, x) FROM seed)),
        cue AS (SELECT page_id, y, x FROM n WHERE score >= 30), {sql_components('cb', 'cue')},
        strong AS (SELECT page_id, y, x FROM cb WHERE (page_id, component) IN (SELECT (c.page_id, c.component) FROM cb c JOIN n ON n.page_id = c.page_id AND n.y = c.y AND n.x = c.x GROUP BY c.page_id, c.component HAVING max(score) >= 70 AND count(*) >= 0.002 * {W * H}))
        SELECT page_id // 8 AS page_id, CAST(page_id % 8 AS INTEGER) AS shot, y, x FROM (SELECT * FROM beyond UNION SELECT * FROM strong)""",
)
def _(t: Tables):
    c = FU.coverage_counted(t.cell())
    comparison = c.filter("b >= 230 AND shots >= 2")
    return SH.reported_shadow(comparison, c.select(*AT, (F.col("score") / 100).alias("value")), c.filter("shots = 1"), W, H, min_seed=1)


@query(
    "overlap_labels", "I8 D10 H1", "cell",
    f"""WITH n AS (SELECT page_id, shot, y, x, g / 255.0 AS lum, count(*) OVER w AS c, list_sort(list(g / 255.0) OVER w) AS v FROM cell WINDOW w AS (PARTITION BY page_id, y, x)),
        r AS (SELECT *, v[1 + CAST(floor(0.25 * (c - 1)) AS INTEGER)] AS ref FROM n), p AS (SELECT DISTINCT page_id, y, x, ref FROM r),
        h AS (SELECT a.page_id, a.y, a.x, max(b.ref) AS hi FROM p a JOIN p b ON b.page_id = a.page_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
        SELECT r.page_id, shot, r.y, r.x, CAST(CASE WHEN c >= 2 AND lum - ref <= 0.02 THEN 0 WHEN c >= 2 AND lum - hi >= 0.08 THEN 1 END AS VARCHAR) AS label FROM r JOIN h ON h.page_id = r.page_id AND h.y = r.y AND h.x = r.x""",
)
def _(t: Tables):
    c = t.cell().withColumn("lum", F.col("g") / 255)
    return LB.overlap_labels(c, W, H, shift=1, relight=False).select(*AT, F.col("label").cast("string"))


@query("relit_overlap_labels", "I8 I9", "")
def _(t: Tables):
    c = t.cell().withColumn("lum", P.grey(*_bgr()))
    l = LB.overlap_labels(c, W, H, shift=1, step=1, min_cells=20)
    return LB.cleaned_labels(l.drop("ref"), W, H, rim=1).select(*AT, F.round("lum", 6).alias("lum"), F.col("label").cast("string"))


@query(
    "cleaned_labels", "I8 H1 H2", "cell",
    "WITH src AS (SELECT page_id * 8 + shot AS page_id, y, x, CASE WHEN b >= 60 THEN 1 ELSE 0 END AS label FROM (SELECT page_id, 0 AS shot, y, x, max(b) AS b FROM cell GROUP BY ALL)), "
    + sql_erode("inn", "src") + ", one AS (SELECT page_id, y, x FROM src WHERE label = 1), " + sql_erode("oe", "one") + ", " + sql_dilate("solid", "oe")
    + """ SELECT s.page_id // 8 AS page_id, s.y, s.x, CAST(CASE WHEN i.page_id IS NOT NULL AND (label = 0 OR d.page_id IS NOT NULL) THEN label END AS VARCHAR) AS label FROM src s
       LEFT JOIN inn i ON i.page_id = s.page_id AND i.y = s.y AND i.x = s.x LEFT JOIN solid d ON d.page_id = s.page_id AND d.y = s.y AND d.x = s.x""",
)
def _(t: Tables):
    page = t.cell().groupBy("page_id", F.lit(0).alias("shot"), "y", "x").agg(F.max("b").alias("b"))
    l = LB.cleaned_labels(page.withColumn("label", (F.col("b") >= 60).cast("int")), W, H, rim=1)
    return l.select("page_id", "y", "x", F.col("label").cast("string"))


@query(
    "training_samples", "I11 E15", "cell",
    """WITH c AS (SELECT *, count(*) OVER w AS n, (g - min(g) OVER w) / 255.0 AS excess FROM cell WINDOW w AS (PARTITION BY page_id, y, x)),
       l AS (SELECT *, CASE WHEN (n = 1 AND score > 50) OR (n >= 2 AND excess > 0.08) THEN 1 WHEN (n = 1 AND score < 1) OR (n >= 2 AND excess < 0.02) THEN 0 END AS label FROM c),
       k AS (SELECT *, row_number() OVER (PARTITION BY page_id, shot, label ORDER BY y, x) AS rk FROM l WHERE label IS NOT NULL)
       SELECT page_id, shot, y, x, label FROM k WHERE (rk - 1) % CASE label WHEN 1 THEN 3 ELSE 15 END = 0""",
)
def _(t: Tables):
    c = FU.coverage_counted(FU.excess_over_darkest(t.cell(), "g")).withColumn("excess", F.col("excess") / 255).withColumn("truth", F.col("score") / 100)
    return LB.training_samples(c).select(*AT, "label")


@query("exposure_gains", "D19", "")
def _(t: Tables):
    cells = t.cell()
    g = TN.exposure_gains(cells, FU.tone_reference(cells), min_cells=5)
    return g.select("page_id", "shot", *[F.round(F.get("gains", F.lit(i)), 6).alias(f"gain_{c}") for i, c in enumerate("bgr")])


@query("tone_curves", "D20", "")
def _(t: Tables):
    cells = t.cell()
    gains = cells.select("page_id", "shot").distinct().withColumn("gains", F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    c = TN.tone_curves(cells, gains, FU.tone_reference(cells), min_agree=10, min_bin=2)
    return c.withColumn("value", F.round("value", 5))


@query(
    "composition_glare", "I12 H1 H2", "cell",
    "WITH src AS (SELECT page_id, y, x, max(g) / 255.0 AS lum, min(g) / 255.0 AS ref FROM cell GROUP BY ALL), hi AS (SELECT a.page_id, a.y, a.x, max(b.ref) AS h FROM src a JOIN src b ON b.page_id = a.page_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL), "
    "one AS (SELECT s.page_id, s.y, s.x FROM src s JOIN hi ON hi.page_id = s.page_id AND hi.y = s.y AND hi.x = s.x WHERE lum - h >= -0.6), " + sql_erode("inn", "src") + ", " + sql_erode("oe", "one") + ", " + sql_dilate("solid", "oe")
    + " SELECT o.page_id, o.y, o.x FROM one o JOIN inn ON inn.page_id = o.page_id AND inn.y = o.y AND inn.x = o.x JOIN solid d ON d.page_id = o.page_id AND d.y = o.y AND d.x = o.x",
)
def _(t: Tables):
    # The threshold is low because neighbouring cells of these tables have nothing in common.
    c = t.cell()
    page = c.groupBy("page_id", F.lit(0).alias("shot"), "y", "x").agg((F.max("g") / 255).alias("lum"))
    ref = c.groupBy("page_id", "y", "x").agg((F.min("g") / 255).alias("lum"))
    return LB.composition_glare(page, ref, W, H, glare=-0.6, shift=1, rim=1, min_cells=10**9).select("page_id", "y", "x")
