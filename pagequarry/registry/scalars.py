"""Column-function queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as PG
from ..functions import text as TX
from ..mappings import Tables
from ..operators import wording as WD
from ..operators.ordered import numbered
from . import query

_SIZE_TEXT = "CASE c_custkey % 6 WHEN 0 THEN 'Letter' WHEN 1 THEN ' a4' WHEN 2 THEN concat(1 + c_nationkey, 'x', 12.5, 'in') WHEN 3 THEN concat(c_nationkey, ' x 305 MM') WHEN 4 THEN concat('.5x', c_nationkey + 1, '.cm') ELSE concat(c_name, 'x') END"


def _size_text():
    k = F.col("c_custkey") % 6
    n = F.col("c_nationkey")
    return (
        F.when(k == 0, "Letter").when(k == 1, " a4").when(k == 2, F.concat(n + 1, F.lit("x12.5in"))).when(k == 3, F.concat(n, F.lit(" x 305 MM")))
        .when(k == 4, F.concat(F.lit(".5x"), n + 1, F.lit(".cm"))).otherwise(F.concat("c_name", F.lit("x")))
    )


@query(
    "page_sizes", "B1 B30", "",
    f"""WITH s AS (SELECT c_custkey AS album_id, {_SIZE_TEXT} AS text FROM customer), l AS (SELECT *, lower(trim(text)) AS t FROM s),
       m AS (SELECT *, TRY_CAST(regexp_extract(t, '^([0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)\\s*x\\s*([0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)\\s*(in|mm|cm)$', 1) AS DOUBLE) AS a,
         TRY_CAST(regexp_extract(t, '^([0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)\\s*x\\s*([0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)\\s*(in|mm|cm)$', 2) AS DOUBLE) AS b, right(t, 2) AS u FROM l),
       p AS (SELECT *, CASE u WHEN 'in' THEN 1.0 WHEN 'mm' THEN 1 / 25.4 WHEN 'cm' THEN 10 / 25.4 END AS f FROM m),
       r AS (SELECT album_id, text, CASE t WHEN 'letter' THEN 8.5 WHEN 'a4' THEN 210 / 25.4 ELSE CASE WHEN a > 0 AND b > 0 THEN a * f END END AS a_in,
         CASE t WHEN 'letter' THEN 11.0 WHEN 'a4' THEN 297 / 25.4 ELSE CASE WHEN a > 0 AND b > 0 THEN b * f END END AS b_in FROM p)
       SELECT album_id, text, round(coalesce(a_in, 8.5), 6) AS a_in, round(coalesce(b_in, 11.0), 6) AS b_in, a_in IS NULL AS resend FROM r""",
)
def _(t: Tables):
    size = TX.page_size(F.col("text"))
    c = t.raw("customer").select(F.col("c_custkey").alias("album_id"), _size_text().alias("text"))
    return c.select("album_id", "text", F.round(F.coalesce(size["a_in"], F.lit(8.5)), 6).alias("a_in"), F.round(F.coalesce(size["b_in"], F.lit(11.0)), 6).alias("b_in"), size.isNull().alias("resend"))


@query("lengths", "B2", "", "SELECT p_partkey AS part, round(CASE p_partkey % 3 WHEN 0 THEN p_size / 25.4 WHEN 1 THEN p_size * 10 / 25.4 ELSE p_size END, 6) AS inches FROM part")
def _(t: Tables):
    k = F.col("p_partkey") % 3
    text = F.concat("p_size", F.lit(" "), F.when(k == 0, "MM").when(k == 1, "cm").otherwise("in"))
    return t.raw("part").select(F.col("p_partkey").alias("part"), F.round(TX.length_inches(text), 6).alias("inches"))


@query(
    "natural_order", "B3 B4", "",
    """WITH s AS (SELECT DISTINCT source FROM documents), n AS (SELECT source, row_number() OVER (ORDER BY lower(regexp_extract(source, '^[^0-9]*')), TRY_CAST(regexp_extract(source, '[0-9]+') AS BIGINT) NULLS FIRST, source) AS rank FROM s)
       SELECT source, rank, lpad(CAST(rank AS VARCHAR), 3, '0') || '-' || regexp_replace(source, '[^A-Za-z0-9._-]', '-', 'g') AS stem FROM n""",
)
def _(t: Tables):
    names = t.raw("documents").select("source").distinct().withColumn("_all", F.lit(1))
    ranked = numbered(names, ["_all"], [TX.natural_key(F.col("source")), "source"], "rank").drop("_all")
    return ranked.withColumn("stem", TX.stem(F.col("rank"), F.col("source")))


@query(
    "ids_and_times", "B5 B6", "",
    """WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN upper(concat(substr(md5(CAST(event_id AS VARCHAR)), 1, 8), '-', substr(md5(CAST(event_id AS VARCHAR)), 9, 4), '-', substr(md5(CAST(event_id AS VARCHAR)), 13, 4), '-', substr(md5(CAST(event_id AS VARCHAR)), 17, 4), '-', substr(md5(CAST(event_id AS VARCHAR)), 21, 12))) ELSE md5(CAST(event_id AS VARCHAR)) END AS id,
         ts, event_id % 4 = 0 AS offset_two FROM events)
       SELECT event_id, CASE WHEN event_id % 3 = 0 THEN lower(id) END AS id, strftime(ts - CASE WHEN offset_two THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM e""",
)
def _(t: Tables):
    h = F.md5(F.col("event_id").cast("string"))
    uuid = F.upper(F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 4 == 0, "+02:00").otherwise("Z"))
    return t.raw("events").select("event_id", TX.canonical_id(F.when(F.col("event_id") % 3 == 0, uuid).otherwise(h)).alias("id"), TX.utc_time(text).alias("at"))


@query(
    "content_keys", "B7 B9", "upload",
    """WITH p AS (SELECT page_id, '[' || string_agg('"' || sha || '"', ',' ORDER BY shot_id, sha) || ']' AS photos FROM (SELECT DISTINCT page_id, shot_id, sha FROM upload) GROUP BY page_id)
       SELECT page_id, 'sha256:' || sha256('{"photos":' || photos || ',"version":"1"}') AS process_key FROM p""",
)
def _(t: Tables):
    from ..plans.album_run import photo_lists

    return photo_lists(t.upload().select("page_id", F.col("shot_id").alias("photo"), "sha")).select("page_id", TX.content_key(F.col("shas").alias("photos"), F.lit("1").alias("version")).alias("process_key"))


@query(
    "print_plans", "B10", "",
    """WITH o AS (SELECT o_orderkey AS page_id, 1000 + o_orderkey % 1500 AS w, 1000 + o_custkey % 1500 AS h, CASE o_orderkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'fill' ELSE 'fit' END AS fit FROM orders),
       p AS (SELECT *, CASE WHEN w >= h THEN 12.0 ELSE 10.0 END AS w_in, CASE WHEN w >= h THEN 10.0 ELSE 12.0 END AS h_in, greatest(w, h) / 12.0 AS cap FROM o),
       q AS (SELECT *, abs((w / h) / (w_in / h_in) - 1) AS mis FROM p)
       SELECT page_id, CAST(w_in * 300 AS INTEGER) AS px_w, CAST(h_in * 300 AS INTEGER) AS px_h, round_even(cap, 1) AS capture_dpi,
         CASE fit WHEN 'auto' THEN CASE WHEN mis <= 0.02 THEN 'stretch' ELSE 'fit' END ELSE fit END AS fit_used,
         concat_ws(',', CASE WHEN mis > 0.02 THEN 'aspect_mismatch' END, CASE WHEN cap < 300 THEN 'upsampled' END, CASE WHEN cap < 150 THEN 'low_resolution' END) AS codes FROM q""",
)
def _(t: Tables):
    m = F.col("o_orderkey") % 3
    p = t.raw("orders").select(F.col("o_orderkey").alias("page_id"), (1000 + F.col("o_orderkey") % 1500).alias("w"), (1000 + F.col("o_custkey") % 1500).alias("h"), F.when(m == 0, "auto").when(m == 1, "fill").otherwise("fit").alias("fit"))
    plan = PG.print_plan(F.col("w"), F.col("h"), F.lit(12.0), F.lit(10.0), F.lit(300), F.col("fit"))
    return p.select("page_id", plan["px_w"].alias("px_w"), plan["px_h"].alias("px_h"), plan["capture_dpi"].alias("capture_dpi"), plan["fit_used"].alias("fit_used"), F.array_join(F.transform(plan["warnings"], lambda w: w["code"]), ",").alias("codes"))


@query("upload_outcomes", "B16", "op",
    """WITH o AS (SELECT seq, kind, CASE CAST(floor(value) AS BIGINT) % 9 WHEN 0 THEN NULL WHEN 1 THEN 400 WHEN 2 THEN 401 WHEN 3 THEN 403 WHEN 4 THEN 404 WHEN 5 THEN 409 WHEN 6 THEN 429 WHEN 7 THEN 503 ELSE 201 END AS status, seq % 2 AS attempts FROM op)
       SELECT seq, CASE WHEN status IS NULL OR status >= 500 OR status = 429 THEN 'retry' WHEN status = 201 THEN 'done' WHEN status = 401 THEN 'auth' ELSE 'blocked' END AS scanner,
         CASE WHEN status IS NULL THEN 'retry' WHEN status IN (401, 403) THEN 'auth' WHEN status = 201 THEN 'done' WHEN status = 404 AND kind = 'MOVE_SHOTS' THEN 'drop'
           WHEN status = 400 THEN CASE WHEN kind = 'PUT_SHOT' AND attempts < 1 THEN 'retry' ELSE 'drop' END WHEN status = 409 THEN 'drop' ELSE 'retry' END AS phone FROM o""",
)
def _(t: Tables):
    v = F.floor("value").cast("bigint") % 9
    status = F.when(v == 1, 400).when(v == 2, 401).when(v == 3, 403).when(v == 4, 404).when(v == 5, 409).when(v == 6, 429).when(v == 7, 503).when(v == 8, 201)
    o = t.op().withColumn("status", status)
    return o.select("seq", PG.scanner_outcome(F.col("status")).alias("scanner"), PG.phone_outcome(F.col("status"), F.col("kind"), F.col("seq") % 2).alias("phone"))


@query(
    "boxes_in_shots", "B17 B18 K3", "",
    """WITH b AS (SELECT l_orderkey AS page_id, l_linenumber AS line, l_partkey, l_suppkey, l_quantity * 10 AS x0, l_discount * 1000 AS y0, l_quantity * 10 + 40 AS x1, l_discount * 1000 + 30 AS y1, l_suppkey * 5.0 AS tx, l_tax * 0.001 AS p FROM lineitem),
       k AS (SELECT unnest(range(9)) / 8.0 AS v), o AS (SELECT page_id, line, l_partkey, l_suppkey, tx, p, x0, y0, x0 + v * (x1 - x0) AS x, y0 AS y FROM b, k UNION ALL SELECT page_id, line, l_partkey, l_suppkey, tx, p, x0, y0, x0 + v * (x1 - x0), y1 FROM b, k
         UNION ALL SELECT page_id, line, l_partkey, l_suppkey, tx, p, x0, y0, x0, y0 + v * (y1 - y0) FROM b, k UNION ALL SELECT page_id, line, l_partkey, l_suppkey, tx, p, x0, y0, x1, y0 + v * (y1 - y0) FROM b, k),
       m AS (SELECT page_id, line, l_partkey, l_suppkey, x0, y0, tx, (x - tx) / (p * x + 1) AS mx, y / (p * x + 1) AS my FROM o),
       g AS (SELECT page_id, line, l_partkey, l_suppkey, greatest(floor(min(mx)), 0) AS a, greatest(floor(min(my)), 0) AS b, least(ceil(max(mx)), 399) AS c, least(ceil(max(my)), 299) AS d FROM m GROUP BY page_id, line, l_partkey, l_suppkey, x0, y0, tx)
       SELECT page_id, line, CASE WHEN c > a AND d > b THEN concat(CAST(a AS INTEGER), ',', CAST(b AS INTEGER), ',', CAST(c AS INTEGER), ',', CAST(d AS INTEGER)) END AS box, round(CASE WHEN c > a AND d > b THEN (c + 1) / 400 END, 6) AS right_edge FROM g""",
)
def _(t: Tables):
    c = F.col
    x0, y0 = c("l_quantity") * 10, c("l_discount") * 1000
    h = [F.lit(1.0), F.lit(0.0), -(c("l_suppkey") * 5.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), c("l_tax") * 0.001, F.lit(0.0), F.lit(1.0)]
    # Rows alike in every input are one box, as in the check query.
    rows = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax").distinct()
    pts = rows.withColumn("p", PG.shot_box_extent(x0, y0, x0 + 40, y0 + 30, h)).withColumn("box", PG.shot_box(c("p"), F.lit(400), F.lit(300)))
    rect = PG.shot_rect(c("box"), F.lit(400), F.lit(300))
    return pts.select(c("l_orderkey").alias("page_id"), c("l_linenumber").alias("line"), F.array_join(F.transform("box", lambda v: v.cast("string")), ",").alias("box"), F.round(F.get(rect, F.lit(2)), 6).alias("right_edge"))


@query(
    "page_sources", "B21 B22 B23", "",
    """WITH p AS (SELECT l_orderkey AS page_id, CASE WHEN l_quantity > 8 THEN 'page-scanner 1.2' ELSE 'camera' END AS software, CASE WHEN l_tax > 0.01 THEN round_even(CASE WHEN l_linenumber < 6 THEN 300.0::DOUBLE ELSE 600.0::DOUBLE END * CASE WHEN l_orderkey % 3 = 0 THEN 2.54::DOUBLE ELSE 1.0::DOUBLE END, 2) END AS res FROM lineitem),
       g AS (SELECT page_id, bool_and(software LIKE 'page-scanner %') AS scan, count(DISTINCT res) AS n, bool_or(res IS NULL) AS unknown, min(res) AS dpi FROM p GROUP BY page_id)
       SELECT page_id, CASE WHEN scan THEN 'scan' ELSE 'photo' END AS source, CASE WHEN scan AND n = 1 AND NOT unknown THEN dpi END AS dpi, CASE WHEN scan THEN 'off' ELSE 'auto' END AS curvature FROM g""",
)
def _(t: Tables):
    from ..plans.album_run import page_sources

    photo = t.raw("lineitem").select(F.col("l_orderkey").alias("page_id"), F.when(F.col("l_quantity") > 8, "page-scanner 1.2").otherwise("camera").alias("software"), F.when(F.col("l_tax") > 0.01, F.when(F.col("l_linenumber") < 6, 300.0).otherwise(600.0)).alias("resolution"), F.when(F.col("l_orderkey") % 3 == 0, 3).when(F.col("l_orderkey") % 3 == 1, 2).alias("unit"))
    s = page_sources(photo, "page-scanner ")
    opt = PG.source_options(F.col("source"), F.lit(True), F.lit("auto"), F.lit(True))
    return s.select("page_id", "source", "dpi", opt["curvature"].alias("curvature"))


@query(
    "rectangle_aspects", "B28", "",
    """WITH o AS (SELECT o_orderkey AS page_id, o_orderkey % 40 AS dx, o_custkey % 30 AS dy FROM orders),
       c AS (SELECT *, -300.0 + dx AS ax, -200.0 + dy AS ay, 300.0 - dy AS bx, -210.0 AS by_, 310.0 AS cx, 220.0 - dx AS cy, -305.0 AS ex, 215.0 + dy AS ey FROM o),
       d AS (SELECT *, (sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) + sqrt(pow(cx - ex, 2) + pow(cy - ey, 2))) / 2 AS wide, (sqrt(pow(ex - ax, 2) + pow(ey - ay, 2)) + sqrt(pow(cx - bx, 2) + pow(cy - by_, 2))) / 2 AS high,
         ((ay - cy) * ex - (ax - cx) * ey + (ax * cy - ay * cx)) / ((by_ - cy) * ex - (bx - cx) * ey + (bx * cy - by_ * cx)) AS k2,
         ((ay - cy) * bx - (ax - cx) * by_ + (ax * cy - ay * cx)) / ((ey - cy) * bx - (ex - cx) * by_ + (ex * cy - ey * cx)) AS k3 FROM c),
       e AS (SELECT *, k2 * bx - ax AS p, k2 * by_ - ay AS q, k2 - 1 AS r, k3 * ex - ax AS s, k3 * ey - ay AS t, k3 - 1 AS u FROM d),
       f AS (SELECT page_id, wide / high AS naive, sqrt(((p * p + q * q) / 640000.0 + r * r) / ((s * s + t * t) / 640000.0 + u * u)) AS aspect FROM e)
       SELECT page_id, round(CASE WHEN aspect > 0.5 * naive AND aspect < 2 * naive THEN aspect ELSE naive END, 6) AS aspect FROM f""",
)
def _(t: Tables):
    dx, dy = F.col("o_orderkey") % 40, F.col("o_custkey") % 30
    lit = F.lit
    corners = [(dx - 300.0, dy - 200.0), (300.0 - dy, lit(-210.0)), (lit(310.0), 220.0 - dx), (lit(-305.0), dy + 215.0)]
    return t.raw("orders").select(F.col("o_orderkey").alias("page_id"), F.round(PG.rectangle_aspect(corners, lit(0.0), lit(0.0), lit(800.0)), 6).alias("aspect"))


@query(
    "glare_messages", "B13 B12", "",
    """WITH r AS (SELECT l_orderkey AS page_id, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS single, sum(l_quantity) / 1000 AS fraction,
         min_by(CASE l_linenumber % 3 WHEN 0 THEN 'top-left' WHEN 1 THEN 'centre' ELSE 'bottom' END, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS largest FROM lineitem GROUP BY l_orderkey)
       SELECT page_id, printf('Glare remains on %.1f%% of the page in %d area%s (%s).', fraction * 100, n, CASE WHEN n > 1 THEN 's' ELSE '' END, CASE WHEN n = 1 THEN largest ELSE 'largest ' || largest END) ||
         CASE WHEN single = n AND n = 1 THEN ' It was seen by only one photo; add a shot of that area from a different angle.' WHEN single = n THEN ' Each was seen by only one photo; add shots of those areas from a different angle.'
           WHEN single > 0 THEN ' ' || single || CASE WHEN single = 1 THEN ' of them was' ELSE ' of them were' END || ' seen by only one photo; add shots of those areas from a different angle. Every photo had glare on the rest; change the light or the camera angle for those.'
           ELSE ' Every photo had glare there; change the light or the camera angle for all the shots.' END AS message FROM r""",
)
def _(t: Tables):
    m = F.col("l_linenumber") % 3
    li = t.raw("lineitem").withColumn("page_id", F.col("l_orderkey")).withColumn("cause", F.when(F.col("l_returnflag") == "A", "single_shot").otherwise("all_shots_glared"))
    li = li.withColumn("location", F.when(m == 0, "top-left").when(m == 1, "centre").otherwise("bottom")).withColumn("ord", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    fractions = li.groupBy("page_id").agg((F.sum("l_quantity") / 1000).alias("fraction"))
    return WD.glare_message(WD.region_summary(li, ["page_id"]).join(fractions, "page_id")).select("page_id", "message")


@query(
    "added_page_warnings", "B14 B15", "feedback",
    """WITH f AS (SELECT page_id, code, round(page_id % 97 / 97.0, 3) AS coverage, CASE WHEN page_id % 4 = 0 THEN 2 ELSE 0 END AS dropped FROM feedback)
       SELECT page_id, concat_ws('|', CASE WHEN coverage < 0.99 AND f.code <> 'incomplete_coverage' THEN printf('photos cover only %.1f%% of the page', coverage * 100) END,
         CASE WHEN dropped > 0 AND f.code <> 'photos_dropped' THEN 'photos [1, 2] matched no other photo and were not used' END) AS added,
         CASE WHEN state = 'ready' THEN 'captured at only 90 dpi (scanned at 90 dpi); scan at a higher resolution' ELSE 'captured at only 90 dpi; shoot closer or in overlapping parts' END AS low_resolution FROM f JOIN feedback USING (page_id)""",
)
def _(t: Tables):
    f = t.feedback().withColumn("coverage", F.round(F.col("page_id") % 97 / 97.0, 3)).withColumn("dropped", F.when(F.col("page_id") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>")))
    added = PG.added_warnings(F.array("code"), F.col("coverage"), F.transform("dropped", lambda d: d.cast("string")))
    low = PG.scan_wording(F.lit("low_resolution"), F.lit("captured at only 90 dpi; shoot closer or in overlapping parts"), F.when(F.col("state") == "ready", "scan").otherwise("photo"), F.lit(90.0))
    return f.select("page_id", F.array_join(F.transform(added, lambda w: w["message"]), "|").alias("added"), low.alias("low_resolution"))


@query(
    "warning_reader", "B29 A4", "",
    """WITH d AS (SELECT l_orderkey AS page_id, l_linenumber AS line, l_partkey, l_suppkey, l_partkey % 5 AS kind, l_quantity FROM lineitem)
       SELECT page_id, line, l_partkey AS part, CASE WHEN kind IN (0, 4) THEN 0 ELSE 1 END AS warnings, CASE WHEN kind IN (1, 2, 3) THEN 'glare' END AS code,
         CASE WHEN kind = 1 THEN 1 ELSE 0 END AS boxes FROM d""",
)
def _(t: Tables):
    from ..sources.reports import parsed_warnings

    k = F.col("l_partkey") % 5
    text = (
        F.when(k == 0, "not json").when(k == 1, '[{"code":"glare","message":"m","regions":[{"bbox":[0,0,1,1],"location":"top","shot_boxes":{"0":[1,2,3,4],"1":[1,2]},"extra":7}]}]')
        .when(k == 2, '[{"code":"glare","regions":3}]').when(k == 3, '[{"code":"glare","message":"m"}]').otherwise("[]")
    )
    rows = t.raw("lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), text.alias("warnings_json"))
    w = rows.withColumn("w", parsed_warnings(F.col("warnings_json")))
    first = F.get("w", F.lit(0))
    boxes = F.aggregate(F.coalesce(first["regions"], F.array().cast(w.schema["w"].dataType.elementType["regions"].dataType)), F.lit(0), lambda acc, r: acc + F.size(F.map_keys(F.coalesce(r["shot_boxes"], F.create_map().cast("map<string,array<int>>")))))
    return w.select("page_id", "line", "part", F.size("w").alias("warnings"), first["code"].alias("code"), F.coalesce(boxes, F.lit(0)).alias("boxes"))


@query(
    "metadata_errors", "B31 G4", "",
    """SELECT c_custkey AS album_id, concat_ws('; ', CASE WHEN c_nationkey = 3 THEN 'name: must not be blank' END, CASE WHEN c_acctbal < 0 THEN 'page_size: cannot be parsed' END,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'pages: listed twice' END, CASE WHEN c_nationkey > 20 THEN 'created: not an ISO 8601 time' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unknown key' END) AS errors FROM customer""",
)
def _(t: Tables):
    c = t.raw("customer")
    page = F.lit("0000abcd-0000-4000-8000-000000000001")
    size = TX.page_size(F.when(F.col("c_acctbal") < 0, "10x").otherwise("10x12in")).isNotNull()
    keys = F.when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("name"), F.lit("colour"))).otherwise(F.array(F.lit("name")))
    unknown = F.array_except(keys, F.array(*[F.lit(k) for k in ("name", "page_size", "pages", "created")]))
    e = PG.metadata_errors(F.when(F.col("c_nationkey") == 3, " ").otherwise(F.col("c_name")), size, F.when(F.col("c_mktsegment") == "BUILDING", F.array(page, F.upper(page))).otherwise(F.array(page)), F.when(F.col("c_nationkey") > 20, "yesterday").otherwise("2024-01-02T03:04:05Z"), unknown)
    return c.select(F.col("c_custkey").alias("album_id"), F.array_join(e, "; ").alias("errors"))
