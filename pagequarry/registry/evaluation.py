"""Matching, evaluation and replay queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..mappings import GRID_H as H
from ..mappings import GRID_W as W
from ..mappings import Tables
from ..operators import evaluate as EV
from ..operators import fusion as FU
from ..operators import matching as MA
from ..operators import replay as RP
from ..session import work_folder, written
from . import query


def _descriptors(t: Tables):
    """A page for every hundred descriptors, so that a page stays one page however many there are."""
    return t.raw("embeddings").select(F.floor(F.col("vec_id") / 100).cast("bigint").alias("page_id"), (F.col("label") % 3).alias("photo"), F.col("vec_id").alias("point"), F.col("embedding").alias("vec"))


@query(
    "descriptor_matches", "C14", "",
    """WITH d AS (SELECT vec_id // 100 AS page_id, label % 3 AS photo, vec_id AS point, embedding::DOUBLE[] AS vec FROM embeddings),
       n AS (SELECT x.page_id, x.photo AS a, y.photo AS b, x.point, y.point AS match, list_distance(x.vec, y.vec) AS dist, row_number() OVER (PARTITION BY x.page_id, x.photo, y.photo, x.point ORDER BY list_distance(x.vec, y.vec), y.point) AS r
         FROM d x JOIN d y ON x.page_id = y.page_id AND x.photo < y.photo)
       SELECT p.page_id, p.a, p.b, p.point, p.match, round(p.dist, 6) AS distance FROM n p JOIN n q ON q.page_id = p.page_id AND q.a = p.a AND q.b = p.b AND q.point = p.point AND p.r = 1 AND q.r = 2 WHERE p.dist < 0.95 * q.dist""",
)
def _(t: Tables):
    return MA.ratio_matches(_descriptors(t), ratio=0.95).withColumn("distance", F.round("distance", 6))


_PAIRS = "pr AS (SELECT l_suppkey AS page_id, l_linenumber AS a, CAST(l_partkey % 7 + 1 AS INTEGER) AS b, count(*) AS inliers FROM lineitem WHERE l_linenumber < l_partkey % 7 + 1 GROUP BY ALL)"


def _pairs(t: Tables):
    b = (F.col("l_partkey") % 7 + 1).cast("int")
    li = t.raw("lineitem").filter(F.col("l_linenumber") < b)  # a pair names its lower photo first
    return li.groupBy(F.col("l_suppkey").alias("page_id"), F.col("l_linenumber").alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("inliers"))


def _photos(t: Tables):
    return t.raw("lineitem").select(F.col("l_suppkey").alias("page_id"), F.col("l_linenumber").alias("photo")).distinct()


@query(
    "photo_strengths", "D34", "",
    f"""WITH {_PAIRS}, s AS (SELECT page_id, photo, CAST(sum(inliers) AS BIGINT) AS strength FROM (SELECT page_id, a AS photo, inliers FROM pr UNION ALL SELECT page_id, b, inliers FROM pr) GROUP BY ALL)
       SELECT page_id, photo, strength, row_number() OVER (PARTITION BY page_id ORDER BY strength DESC, photo) = 1 AS is_reference FROM s""",
)
def _(t: Tables):
    return MA.strengths(_pairs(t))


@query(
    "photos_reached", "H12 H6", "",
    f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT page_id, a, b FROM pr UNION SELECT page_id, b, a FROM pr),
       s AS (SELECT page_id, photo, sum(inliers) AS strength FROM (SELECT page_id, a AS photo, inliers FROM pr UNION ALL SELECT page_id, b, inliers FROM pr) GROUP BY ALL),
       ref AS (SELECT page_id, photo FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY strength DESC, photo) AS n FROM s) WHERE n = 1),
       r AS (SELECT page_id, photo FROM ref UNION SELECT e.page_id, e.b FROM r JOIN e ON e.page_id = r.page_id AND e.a = r.photo)
       SELECT p.page_id, p.photo, r.photo IS NOT NULL AS reached FROM (SELECT DISTINCT l_suppkey AS page_id, l_linenumber AS photo FROM lineitem) p LEFT JOIN r ON r.page_id = p.page_id AND r.photo = p.photo""",
)
def _(t: Tables):
    return MA.reached(_photos(t), _pairs(t))


@query("match_tree", "H12 H13", "")
def _(t: Tables):
    h = F.array(*[F.lit(v) for v in (1.0, 0.0)], F.col("a") * 10.0, *[F.lit(v) for v in (0.0, 1.0)], F.col("b") * 5.0, *[F.lit(v) for v in (0.0, 0.0, 1.0)])
    tree = MA.match_tree(_photos(t), _pairs(t).withColumn("h", h))
    return tree.select("page_id", "photo", F.col("parent").cast("string"), F.col("placed").cast("string"), F.array_join(F.transform("to_reference", lambda v: F.round(v, 6).cast("string")), ",").alias("to_reference"))


_SEG = "sg AS (SELECT l_suppkey AS page_id, l_orderkey * 100 + l_linenumber AS seg, min(l_partkey % 200) AS x1, min(l_orderkey % 160) AS y1, min((l_linenumber - 4) * 4) AS dy FROM lineitem GROUP BY ALL)"


def _segments(t: Tables):
    s = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("page_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seg")).agg(
        F.min(F.col("l_partkey") % 200).alias("x1"), F.min(F.col("l_orderkey") % 160).alias("y1"), F.min((F.col("l_linenumber") - 4) * 4).alias("dy")
    )
    return s.select("page_id", "seg", F.col("x1").cast("double"), F.col("y1").cast("double"), (F.col("x1") + 12).cast("double").alias("x2"), (F.col("y1") + F.col("dy")).cast("double").alias("y2"))


def _written_segments(t: Tables):
    """Segments that several steps read: grouped and written out once."""
    return written(_segments(t), work_folder(t.spark, "segments"))


_LINKS = _SEG + """, s2 AS (SELECT page_id, seg, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x1 + 12.0::DOUBLE AS x2, (y1 + dy)::DOUBLE AS y2, sqrt(144.0::DOUBLE + dy * dy) AS len FROM sg), s3 AS (SELECT *, (x2 - x1) / len AS dx, (y2 - y1) / len AS dy FROM s2),
       ends AS (SELECT a.page_id, a.seg AS a, b.seg AS b, a.x1, a.y1, a.dx, a.dy, b.x1 AS bx1, b.y1 AS by1, b.dx AS bdx, b.dy AS bdy,
         list_min([(sqrt(pow(a.x1 - b.x1, 2) + pow(a.y1 - b.y1, 2)), 0, a.x1, a.y1, b.x1, b.y1), (sqrt(pow(a.x1 - b.x2, 2) + pow(a.y1 - b.y2, 2)), 1, a.x1, a.y1, b.x2, b.y2),
           (sqrt(pow(a.x2 - b.x1, 2) + pow(a.y2 - b.y1, 2)), 2, a.x2, a.y2, b.x1, b.y1), (sqrt(pow(a.x2 - b.x2, 2) + pow(a.y2 - b.y2, 2)), 3, a.x2, a.y2, b.x2, b.y2)]) AS m
         FROM s3 a JOIN s3 b ON a.page_id = b.page_id AND a.seg < b.seg AND a.dx * b.dx + a.dy * b.dy >= cos(radians(6))),
       lk AS (SELECT page_id, a, b FROM ends WHERE m[1] <= 6 AND abs((m[5] - x1) * dy - (m[6] - y1) * dx) <= 2 AND abs((m[3] - bx1) * bdy - (m[4] - by1) * bdx) <= 2)"""


@query("segment_links", "C15", "", f"WITH {_LINKS} SELECT page_id, a, b FROM lk")
def _(t: Tables):
    return MA.segment_links(_segments(t), 6, 6.0, 2.0)


@query(
    "segment_chains", "C15 H6", "",
    f"""WITH RECURSIVE {_LINKS}, e AS (SELECT page_id, a, b FROM lk UNION SELECT page_id, b, a FROM lk), r AS (SELECT page_id, seg, seg AS chain FROM s3 UNION SELECT e.page_id, e.b, r.chain FROM r JOIN e ON e.page_id = r.page_id AND e.a = r.seg AND r.chain < e.b)
       SELECT page_id, seg, min(chain) AS chain FROM r GROUP BY page_id, seg""",
)
def _(t: Tables):
    return MA.chains(_written_segments(t), 6, 6.0, 2.0)


@query(
    "line_straightness", "D33", "",
    f"""WITH {_SEG}, s2 AS (SELECT page_id, y1 % 16 AS chain, seg, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x1 + 12.0::DOUBLE AS x2, (y1 + dy)::DOUBLE AS y2, CAST(greatest(2, floor(sqrt(144.0 + dy * dy) / 2)) AS INTEGER) AS n FROM sg),
       p AS (SELECT page_id, chain, seg, x1 + k / (n - 1) * (x2 - x1) AS px, y1 + k / (n - 1) * (y2 - y1) AS py FROM (SELECT *, unnest(range(n)) AS k FROM s2)),
       m AS (SELECT page_id, chain, avg(px) AS mx, avg(py) AS my, 0.5 * atan2(2 * covar_pop(px, py), var_pop(px) - var_pop(py)) AS an, count(DISTINCT seg) AS pieces FROM p GROUP BY ALL)
       SELECT page_id, chain, pieces, round(max((px - mx) * cos(an) + (py - my) * sin(an)) - min((px - mx) * cos(an) + (py - my) * sin(an)), 4) AS span, round(max(abs((py - my) * cos(an) - (px - mx) * sin(an))), 4) AS deviation
       FROM p JOIN m USING (page_id, chain) GROUP BY page_id, chain, pieces""",
)
def _(t: Tables):
    s = _segments(t)
    lines = MA.straightness(s, s.select("page_id", "seg", (F.col("y1") % 16).cast("bigint").alias("chain")), 0.0)
    return lines.select("page_id", "chain", "pieces", F.round("span", 4).alias("span"), F.round("deviation", 4).alias("deviation"))


_CHAINED = _LINKS + """, e AS (SELECT page_id, a, b FROM lk UNION SELECT page_id, b, a FROM lk), r AS (SELECT page_id, seg, seg AS chain FROM s3 UNION SELECT e.page_id, e.b, r.chain FROM r JOIN e ON e.page_id = r.page_id AND e.a = r.seg AND r.chain < e.b),
       ch AS (SELECT page_id, seg, min(chain) AS chain FROM r GROUP BY page_id, seg), cs AS (SELECT s2.*, ch.chain, CAST(greatest(2, floor(len / 2)) AS INTEGER) AS n FROM s2 JOIN ch ON ch.page_id = s2.page_id AND ch.seg = s2.seg),
       p AS (SELECT page_id, chain, seg, x1 + k / (n - 1) * (x2 - x1) AS px, y1 + k / (n - 1) * (y2 - y1) AS py FROM (SELECT *, unnest(range(n)) AS k FROM cs)),
       m AS (SELECT page_id, chain, avg(px) AS mx, avg(py) AS my, 0.5 * atan2(2 * covar_pop(px, py), var_pop(px) - var_pop(py)) AS an, count(DISTINCT seg) AS pieces FROM p GROUP BY ALL),
       li AS (SELECT page_id, chain, pieces, max((px - mx) * cos(an) + (py - my) * sin(an)) - min((px - mx) * cos(an) + (py - my) * sin(an)) AS span, max(abs((py - my) * cos(an) - (px - mx) * sin(an))) AS deviation FROM p JOIN m USING (page_id, chain) GROUP BY page_id, chain, pieces)"""


def _chained(t: Tables, min_span: float):
    s = _written_segments(t)
    return MA.straightness(s, MA.chains(s, 6, 6.0, 2.0), min_span)


@query("chain_straightness", "D33 C15", "", f"WITH RECURSIVE {_CHAINED} SELECT page_id, chain, pieces, round(span, 4) AS span, round(deviation, 4) AS deviation FROM li WHERE pieces > 1")
def _(t: Tables):
    # The pieces of a line, linked end to end.
    lines = _chained(t, 0.0).filter("pieces > 1")
    return lines.select("page_id", "chain", "pieces", F.round("span", 4).alias("span"), F.round("deviation", 4).alias("deviation"))


@query(
    "page_straightness", "D33", "",
    f"WITH RECURSIVE {_CHAINED} SELECT page_id, count(*) AS lines, round(max(deviation), 4) AS worst, round(coalesce(median(deviation) FILTER (pieces > 1), 0), 4) AS median FROM li WHERE span >= 14 GROUP BY page_id",
)
def _(t: Tables):
    p = MA.page_straightness(_chained(t, 14.0))
    return p.select("page_id", "lines", F.round("worst", 4).alias("worst"), F.round("median", 4).alias("median"))


@query(
    "geometry_error", "D35", "",
    """WITH m AS (SELECT vec_id // 100 AS page_id, vec_id AS point, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE / 100 AS ex, embedding[4]::DOUBLE / 100 AS ey FROM embeddings),
       n AS (SELECT a.page_id, a.point, b.ex, b.ey, row_number() OVER (PARTITION BY a.page_id, a.point ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.point) AS r FROM m a JOIN m b ON a.page_id = b.page_id),
       d AS (SELECT page_id, point, median(ex) AS mx, median(ey) AS my FROM n WHERE r BETWEEN 2 AND 9 GROUP BY ALL),
       o AS (SELECT m.page_id, sqrt(ex * ex + ey * ey) AS d FROM m JOIN d ON d.page_id = m.page_id AND d.point = m.point WHERE sqrt(pow(ex - mx, 2) + pow(ey - my, 2)) < 0.003 AND sqrt(ex * ex + ey * ey) < 0.004)
       SELECT page_id, round(max(d), 7) AS worst, round(quantile_cont(d, 0.95), 7) AS p95, count(*) AS matches FROM o GROUP BY page_id""",
)
def _(t: Tables):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    m = t.raw("embeddings").select(F.floor(F.col("vec_id") / 100).cast("bigint").alias("page_id"), F.col("vec_id").alias("point"), e(0).alias("x"), e(1).alias("y"), (e(2) / 100).alias("ex"), (e(3) / 100).alias("ey"))
    g = MA.geometry_error(m, 0.003, 0.004)
    return g.select("page_id", F.round("worst", 7).alias("worst"), F.round("p95", 7).alias("p95"), "matches")


@query(
    "mask_scores", "D24", "",
    """WITH r AS (SELECT source, toxic = 1 AS p, quality = 1 AS t FROM labels JOIN documents USING (doc_id))
       SELECT source, round_even(count(*) FILTER (p AND t) / greatest(count(*) FILTER (t), 1), 4) AS recall, round_even(count(*) FILTER (p AND NOT t) / greatest(count(*) FILTER (NOT t), 1), 4) AS false_positive_share,
         round_even(count(*) FILTER (p AND t) / greatest(count(*) FILTER (p OR t), 1), 4) AS iou FROM r GROUP BY source""",
)
def _(t: Tables):
    r = t.raw("labels").join(t.raw("documents").select("doc_id", "source"), "doc_id")
    return EV.mask_scores(r.select("source", (F.col("toxic") == 1).alias("pred"), (F.col("quality") == 1).alias("truth")), ["source"])


@query(
    "pooled_rates", "D25", "",
    """WITH r AS (SELECT source, toxic = 1 AS p, quality AS l FROM labels JOIN documents USING (doc_id))
       SELECT coalesce(source, 'all') AS page, round(count(*) FILTER (p AND l = 1) / greatest(count(*) FILTER (l = 1), 1), 6) AS recall, round(count(*) FILTER (p AND l = 0) / greatest(count(*) FILTER (l = 0), 1), 6) AS false_alarms,
         round(count(*) FILTER (l = 1) / greatest(count(*) FILTER (l IN (0, 1)), 1), 6) AS glare_share FROM r GROUP BY GROUPING SETS ((source), ())""",
)
def _(t: Tables):
    r = t.raw("labels").join(t.raw("documents").select("doc_id", "source"), "doc_id").select("source", (F.col("toxic") == 1).alias("pred"), F.col("quality").alias("label"))
    p = EV.pooled_rates(r, "source")
    return p.select(F.coalesce("source", F.lit("all")).alias("page"), *[F.round(c, 6).alias(c) for c in ("recall", "false_alarms", "glare_share")])


@query(
    "residual_detection", "D26", "cell",
    """SELECT page_id, round(count(*) FILTER (score >= 50 AND g > 128) / greatest(count(*) FILTER (g > 128), 1), 6) AS recall, round(count(*) FILTER (score >= 50 AND g < 3) / greatest(count(*) FILTER (g < 3), 1), 6) AS false_share FROM cell GROUP BY page_id""",
)
def _(t: Tables):
    c = t.cell().withColumn("residual", F.col("score") / 100).withColumn("truth", F.col("g") / 256)
    d = EV.residual_detection(c, ["page_id"])
    return d.select("page_id", F.round("recall", 6).alias("recall"), F.round("false_share", 6).alias("false_share"))


@query(
    "setting_sweep", "D30 I17", "",
    """WITH c AS (SELECT s.threshold, l_returnflag AS grp, l_linenumber AS shots, CASE WHEN l_quantity >= s.threshold THEN 1 ELSE 0 END AS hit, l_discount AS f, l_tax AS depth FROM lineitem, (SELECT unnest([10, 25, 40]) AS threshold) s)
       SELECT threshold, grp, shots, round(avg(hit), 6) AS recall, round(max(f), 6) AS worst_false, count(*) FILTER (depth >= 0.05 AND hit >= 0.5) AS deep_found, count(*) FILTER (depth >= 0.05) AS deep FROM c GROUP BY ALL""",
)
def _(t: Tables):
    cases = t.raw("lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("shots"), "l_quantity", F.col("l_discount").alias("false"), F.col("l_tax").alias("depth"))
    settings = t.spark.createDataFrame([(10,), (25,), (40,)], "threshold int")

    def score(df):
        hit = (F.col("l_quantity") >= F.col("threshold")).cast("double")
        return df.withColumn("recall", hit).withColumn("found", hit).withColumn("error", F.lit(0.0)).withColumn("changed", hit > 0).withColumn("reported", hit > 0).withColumn("depth", F.when(F.col("depth") >= 0.05, 0.4).otherwise(0.0))

    s = EV.sweep(cases, settings, score, ["grp", "shots"])
    return s.select("threshold", "grp", "shots", F.round("recall", 6).alias("recall"), F.round("worst_false", 6).alias("worst_false"), "deep_found", "deep")


@query(
    "image_error", "D31", "cell",
    """WITH gn AS (SELECT page_id, sum(b * r)::DOUBLE / greatest(sum(b * b), 1) AS gb, sum(g * r)::DOUBLE / greatest(sum(g * g), 1) AS gg, sum(r * g)::DOUBLE / greatest(sum(r * r), 1) AS gr FROM cell GROUP BY page_id),
       e AS (SELECT c.page_id, x, abs(b * gb - r) + abs(g * gg - r) + abs(r * gr - g) AS err, b * gb + g * gg + r * gr - r - r - g AS br FROM cell c JOIN gn USING (page_id))
       SELECT page_id, round(avg(err / 3), 5) AS mae, round(avg(CASE WHEN br / 3 > 35 THEN 1 ELSE 0 END), 6) AS glare_share, round(avg(CASE WHEN x < 5 THEN err / 3 END), 5) AS strip_mae, round(avg(CASE WHEN x >= 5 THEN err / 3 END), 5) AS rest_mae FROM e GROUP BY page_id""",
)
def _(t: Tables):
    c = t.cell().select("page_id", "x", *[F.col(c).alias(f"a_{c}") for c in "bgr"], F.col("r").alias("t_b"), F.col("r").alias("t_g"), F.col("g").alias("t_r"))
    e = EV.image_error(c, ["page_id"], F.col("x") < 5)
    return e.select("page_id", F.round("mae", 5).alias("mae"), F.round("glare_share", 6).alias("glare_share"), F.round("strip_mae", 5).alias("strip_mae"), F.round("rest_mae", 5).alias("rest_mae"))


@query(
    "residual_truth", "D32", "cell",
    """WITH ok AS (SELECT * FROM cell WHERE least(b, g, r) > 5), gn AS (SELECT page_id, median(round(r / b, 9)) AS gb, median(round(r / g, 9)) AS gg, median(round(g / r, 9)) AS gr FROM ok GROUP BY page_id)
       SELECT page_id, shot, y, x FROM cell c JOIN gn USING (page_id) WHERE (b * gb - r + g * gg - r + r * gr - g) / 3 >= 20""",
)
def _(t: Tables):
    c = t.cell().select("page_id", "shot", "y", "x", *[F.col(c).alias(f"a_{c}") for c in "bgr"], F.col("r").alias("t_b"), F.col("r").alias("t_g"), F.col("g").alias("t_r"))
    # One page's shots share its gain.
    flat = c.withColumn("y", F.struct("shot", "y"))
    out = EV.residual_truth(flat, ["page_id"])
    return out.select("page_id", F.col("y.shot").alias("shot"), F.col("y.y").alias("y"), "x")


@query("glare_fit", "I10", "")
def _(t: Tables):
    c = FU.excess_over_darkest(t.cell(), "g")
    samples = c.select((F.col("excess") > 20).cast("int").alias("label"), (F.col("b") / 255).alias("veil"), (F.col("g") / 255).alias("desat"), (F.col("score") / 100).alias("flat"), (F.col("r") / 255).alias("clip"))
    fit = EV.fit_logistic(samples, ["veil", "desat", "flat", "clip"], clean_weight=1.0)
    return t.spark.createDataFrame([(k, round(v, 3)) for k, v in fit.items()], "name string, weight double")


_SHARES = """ar AS (SELECT page_id, count(*) AS area FROM (SELECT DISTINCT page_id, y, x FROM cell) GROUP BY page_id), sh AS (SELECT page_id, shot, count(*) AS n FROM cell GROUP BY ALL),
       bo AS (SELECT a.page_id, a.shot AS a, b.shot AS b, count(*) AS n FROM cell a JOIN cell b ON a.page_id = b.page_id AND a.y = b.y AND a.x = b.x AND a.shot < b.shot GROUP BY ALL),
       ps AS (SELECT x.page_id, x.shot AS a, y.shot AS b, (x.n + y.n - coalesce(bo.n, 0)) / area AS un, coalesce(bo.n, 0) / area AS overlap, (least(x.n, y.n) - coalesce(bo.n, 0)) / area AS own
         FROM sh x JOIN sh y ON x.page_id = y.page_id AND x.shot < y.shot JOIN ar ON ar.page_id = x.page_id LEFT JOIN bo ON bo.page_id = x.page_id AND bo.a = x.shot AND bo.b = y.shot)"""


@query("shot_pair_shares", "C13 G5", "cell", f'WITH {_SHARES} SELECT page_id, a, b, round(un, 6) AS "union", round(overlap, 6) AS overlap, round(own, 6) AS own FROM ps')
def _(t: Tables):
    p = RP.pair_shares(t.cell())
    return p.select("page_id", "a", "b", *[F.round(c, 6).alias(c) for c in ("union", "overlap", "own")])


@query("stitch_pairs", "E10 C13", "cell", f"WITH {_SHARES} SELECT page_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY overlap, a, b) AS n FROM ps WHERE un >= 0.4 AND overlap < 0.5 AND own >= 0.15) WHERE n <= 6")
def _(t: Tables):
    return RP.stitch_pairs(RP.pair_shares(t.cell()), min_union=0.4, min_own=0.15).select("page_id", "a", "b")


@query(
    "whole_shots", "E11", "cell",
    f"""WITH {_SHARES}, w AS (SELECT sh.page_id, shot, row_number() OVER (PARTITION BY sh.page_id ORDER BY shot) - 1 AS k, count(*) OVER (PARTITION BY sh.page_id) AS m FROM sh JOIN ar ON ar.page_id = sh.page_id WHERE sh.n / area >= 0.2)
       SELECT page_id, shot FROM w WHERE m <= 4 OR k IN (0, CAST(round_even((m - 1) / 3, 0) AS BIGINT), CAST(round_even(2 * (m - 1) / 3, 0) AS BIGINT), m - 1)""",
)
def _(t: Tables):
    return RP.whole_shots(t.cell(), min_cover=0.2)


@query(
    "prompted_shots", "C18", "cell",
    """WITH bx AS (SELECT DISTINCT page_id, rid, y, x FROM (SELECT DISTINCT page_id, shot AS rid FROM cell), (SELECT CAST(unnest(range(5, 15)) AS INTEGER) AS y), (SELECT CAST(unnest(range(5, 20)) AS INTEGER) AS x)),
       cv AS (SELECT b.page_id, b.rid, c.shot, count(*) / 150 AS share FROM bx b JOIN cell c ON c.page_id = b.page_id AND c.y = b.y AND c.x = b.x WHERE c.shot <> b.rid GROUP BY ALL),
       be AS (SELECT page_id, rid, shot AS best FROM (SELECT *, row_number() OVER (PARTITION BY page_id, rid ORDER BY share DESC, shot) AS n FROM cv) WHERE n = 1),
       wo AS (SELECT page_id, rid, shot AS worst FROM (SELECT *, row_number() OVER (PARTITION BY page_id, rid ORDER BY share, shot) AS n FROM cv WHERE share >= 0.15) WHERE n = 1)
       SELECT be.page_id, be.rid, best, coalesce(worst, best) AS worst FROM be LEFT JOIN wo ON wo.page_id = be.page_id AND wo.rid = be.rid""",
)
def _(t: Tables):
    cells = t.cell()
    used = cells.select("page_id", F.col("shot").alias("rid"), "shot").distinct()
    boxes = used.select("page_id", "rid").withColumn("y", F.explode(F.sequence(F.lit(5), F.lit(14)))).withColumn("x", F.explode(F.sequence(F.lit(5), F.lit(19))))
    p = RP.prompted(boxes, cells, used, "worst", min_cover=0.15)
    return p.select("page_id", "rid", "best", F.col("shot").alias("worst"))


@query("glare_replays", "I13 D27 K2", "")
def _(t: Tables):
    cells = written(t.cell().select("page_id", "shot", "y", "x", (F.col("g") / 255).alias("lum")), work_folder(t.spark, "replays"))
    pairs = RP.stitch_pairs(RP.pair_shares(cells), limit=6, min_union=0.3, min_own=0.1)
    rules = F.explode(F.array(F.lit("best"), F.lit("worst")))
    stitched = pairs.select("page_id", F.concat_ws("-", "a", "b").alias("start"), F.explode(F.array("a", "b")).alias("shot"))
    whole = RP.whole_shots(cells, min_cover=0.15).select("page_id", F.col("shot").cast("string").alias("start"), "shot")
    starts = stitched.unionByName(whole).withColumn("rule", rules).withColumn("rid", F.concat_ws("/", "start", "rule")).drop("start")
    r = RP.replays(starts, cells, W, H, RP.darkest_composer(cells, 0.08), min_area=0.004)
    return r.withColumn("shots", F.array_join(F.transform("shots", lambda s: s.cast("string")), ","))


_RES = """re AS (SELECT l_orderkey AS page_id, CASE WHEN l_linenumber % 2 = 0 THEN 'best' ELSE 'worst' END AS rule, CASE WHEN l_linenumber < 4 THEN 'stitch' ELSE 'single' END AS kind, 1000 AS page_px, CAST(floor(l_quantity) AS BIGINT) AS glare_px,
    CAST(floor(l_quantity / 2) AS BIGINT) AS single_px, CAST(floor(l_quantity / 3) AS BIGINT) AS r1, CAST(floor(l_quantity / 2.2) AS BIGINT) AS r2 FROM lineitem)"""


def _results(t: Tables):
    q = F.col("l_quantity")
    return t.raw("lineitem").select(
        F.when(F.col("l_linenumber") % 2 == 0, "best").otherwise("worst").alias("rule"), F.when(F.col("l_linenumber") < 4, "stitch").otherwise("single").alias("kind"), F.lit(1000).alias("page_px"),
        q.cast("bigint").alias("glare_px"), F.floor(q / 2).alias("single_glare_px"), F.floor(q / 3).alias("removed_1"), F.floor(q / 2.2).alias("removed_2"), F.col("l_suppkey").alias("detector"), F.floor(q * F.col("l_discount")).alias("out_px"),
    )


@query(
    "replay_summary", "D28 D29", "",
    f"""WITH {_RES}, s AS (SELECT rule, coalesce(kind, 'all') AS kind, count(*) AS replays, round_even(sum(single_px) / sum(page_px), 4) AS single_glare, round_even(sum(glare_px) / sum(page_px), 4) AS glare,
         round_even(sum(r1) / sum(single_px), 4) AS removed_1, round_even(sum(r2) / sum(single_px), 4) AS removed_2 FROM re GROUP BY GROUPING SETS ((rule), (rule, kind)))
       SELECT *, removed_2 >= 0.8 AS pass FROM s""",
)
def _(t: Tables):
    s = RP.summarised(_results(t)).withColumn("kind", F.coalesce("kind", F.lit("all")))
    return s.withColumn("pass", RP.gate(F.col("removed_2"), F.lit(0.05)))


@query(
    "detector_summary", "D28 D29", "",
    """WITH d AS (SELECT l_suppkey AS detector, CAST(floor(l_quantity) AS BIGINT) AS g, CAST(floor(l_quantity / 2) AS BIGINT) AS s, CAST(floor(l_quantity * l_discount) AS BIGINT) AS o, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS f FROM lineitem)
       SELECT detector, round_even((sum(g) - sum(o)) / sum(g), 4) AS glare_in_warned, round_even(sum(o) / sum(g), 4) AS single_glare_unwarned, round_even(sum(o) / sum(s), 4) AS single_glare_flagged, CAST(sum(f) AS BIGINT) AS regions_flagged,
         round_even(sum(o) / sum(g), 4) <= 0.1 AS pass FROM d GROUP BY detector""",
)
def _(t: Tables):
    q = F.col("l_quantity")
    d = t.raw("lineitem").select(
        F.col("l_suppkey").alias("detector"), q.cast("bigint").alias("glare_px"), F.floor(q / 2).alias("single_glare_px"), F.floor(q * F.col("l_discount")).alias("single_glare_unwarned_px"),
        (q.cast("bigint") - F.floor(q * F.col("l_discount"))).alias("glare_in_warned_px"), F.lit(0).alias("overlap_glare_unwarned_px"), F.floor(q * F.col("l_discount")).alias("single_glare_flagged_px"),
        (F.col("l_tax") > 0.04).cast("bigint").alias("regions_flagged"), F.lit(0).alias("regions_flagged_clean"),
    )
    s = RP.detector_summary(d, ["detector"])
    return s.select("detector", "glare_in_warned", "single_glare_unwarned", "single_glare_flagged", "regions_flagged", RP.gate(F.lit(1.0), F.col("single_glare_unwarned")).alias("pass"))


@query(
    "gated_detectors", "D29 D28", "",
    """WITH re AS (SELECT l_suppkey AS rule, CAST(floor(l_quantity) AS BIGINT) AS g, CAST(floor(l_quantity / 2) AS BIGINT) AS s, CAST(floor(l_quantity / 2 * (1 - l_tax * 3)) AS BIGINT) AS r2, CAST(floor(l_quantity * l_discount * 2) AS BIGINT) AS o FROM lineitem),
       d AS (SELECT rule AS detector, round_even(sum(r2) / sum(s), 4) AS removed_2, round_even(sum(o) / sum(g), 4) AS single_glare_unwarned FROM re GROUP BY rule)
       SELECT *, removed_2 >= 0.8 AND single_glare_unwarned <= 0.1 AS pass FROM d""",
)
def _(t: Tables):
    # Both gate inputs are the summaries' own shares.
    q = F.col("l_quantity")
    out = F.floor(q * F.col("l_discount") * 2)
    rows = t.raw("lineitem").select(
        F.col("l_suppkey").alias("rule"), F.lit("all").alias("kind"), F.lit(1000).alias("page_px"), F.floor(q).alias("glare_px"), F.floor(q / 2).alias("single_glare_px"), F.lit(0).alias("removed_1"),
        F.floor(q / 2 * (1 - F.col("l_tax") * 3)).alias("removed_2"), out.alias("single_glare_unwarned_px"), (F.floor(q) - out).alias("glare_in_warned_px"), F.lit(0).alias("overlap_glare_unwarned_px"),
        F.lit(0).alias("single_glare_flagged_px"), F.lit(0).alias("regions_flagged"), F.lit(0).alias("regions_flagged_clean"),
    )
    removed = RP.summarised(rows).filter("kind IS NULL").select(F.col("rule").alias("detector"), "removed_2")
    warned = RP.detector_summary(rows.withColumnRenamed("rule", "detector"), ["detector"]).select("detector", "single_glare_unwarned")
    return removed.join(warned, "detector").withColumn("pass", RP.gate(F.col("removed_2"), F.col("single_glare_unwarned")))


@query(
    "warned_measures", "D27", "cell",
    """WITH gl AS (SELECT DISTINCT page_id, y, x FROM cell WHERE b >= 200), si AS (SELECT page_id, y, x FROM cell GROUP BY ALL HAVING count(*) = 1), wa AS (SELECT DISTINCT page_id, y, x FROM cell WHERE score >= 50),
       rg AS (SELECT DISTINCT page_id, y, x, y // 5 AS region FROM cell WHERE score >= 30), j AS (SELECT gl.*, si.y IS NOT NULL AS s, wa.y IS NOT NULL AS w, rg.y IS NOT NULL AS f FROM gl LEFT JOIN si USING (page_id, y, x) LEFT JOIN wa USING (page_id, y, x) LEFT JOIN rg USING (page_id, y, x)),
       pr AS (SELECT rg.page_id, region, count(l.y) AS g, count(*) AS n FROM rg LEFT JOIN (SELECT page_id, y, x FROM gl JOIN si USING (page_id, y, x)) l ON l.page_id = rg.page_id AND l.y = rg.y AND l.x = rg.x GROUP BY ALL),
       rr AS (SELECT page_id, count(*) AS regions_flagged, count(*) FILTER (g < 0.001 * n) AS regions_flagged_clean FROM pr GROUP BY page_id)
       SELECT page_id, count(*) FILTER (w) AS glare_in_warned_px, count(*) FILTER (s AND NOT w) AS single_glare_unwarned_px, count(*) FILTER (NOT s AND NOT w) AS overlap_glare_unwarned_px, count(*) FILTER (s AND f) AS single_glare_flagged_px,
         any_value(regions_flagged) AS regions_flagged, any_value(regions_flagged_clean) AS regions_flagged_clean FROM j JOIN rr USING (page_id) GROUP BY page_id""",
)
def _(t: Tables):
    c = t.cell()
    at = ["page_id", "y", "x"]
    single = c.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(*at)
    regions = c.withColumn("region", F.floor(F.col("y") / 5)).filter("score >= 30").select(*at, "region").distinct().withColumn("glare_seen", F.lit(0.5))
    return RP.warned_measures(c.filter("b >= 200").select(*at).distinct(), single, c.filter("score >= 50").select(*at), regions, ["page_id"])


@query("same_page_filter", "I14", "", "SELECT l_orderkey AS page_id, l_linenumber AS line, l_partkey AS part, CASE WHEN l_discount * 10 < 0.3 OR l_tax * 20 > 1.5 THEN 'other_outline' END AS skipped FROM lineitem")
def _(t: Tables):
    return t.raw("lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), RP.same_page(F.col("l_discount") * 10, F.col("l_tax") * 20).alias("skipped"))
