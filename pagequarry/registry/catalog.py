"""Catalogue and feedback queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..mappings import Tables
from ..operators import catalog as C
from ..operators import feedback as FB
from ..operators.ordered import numbered
from . import query

DAY = "yyyy-MM-dd"


@query(
    "album_overview", "C1 D1 A5", "album page shot",
    """SELECT a.album_id, a.name, a.page_size, count(DISTINCT p.page_id) AS pages, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS shots,
       strftime(max(p.changed_at), '%Y-%m-%d') AS updated
       FROM album a LEFT JOIN (SELECT page.*, (SELECT count(*) FROM shot s WHERE s.page_id = page.page_id) AS n FROM page) p ON p.album_id = a.album_id
       GROUP BY ALL""",
)
def _(t: Tables):
    o = C.album_overview(t.album(), t.page_base(), t.shot())
    return o.withColumn("updated", F.date_format("updated", DAY))


@query(
    "album_pages_numbered", "D2 E1", "page shot",
    """SELECT p.album_id, row_number() OVER (PARTITION BY p.album_id ORDER BY p.position) AS number, p.page_id,
       count(s.shot_id) AS shots FROM page p LEFT JOIN shot s ON s.page_id = p.page_id
       GROUP BY p.album_id, p.position, p.page_id""",
)
def _(t: Tables):
    # Positions with gaps, so that the numbers differ from them.
    return C.album_pages(t.page().withColumn("position", F.col("position") * 3), t.shot())


@query(
    "shot_location", "C1", "page shot",
    "SELECT s.shot_id, s.page_id, p.album_id, s.sha, s.bytes, strftime(s.taken, '%Y-%m-%d') AS taken FROM shot s JOIN page p ON p.page_id = s.page_id",
)
def _(t: Tables):
    return C.shot_location(t.shot(), t.page_base()).select("shot_id", "page_id", "album_id", "sha", "bytes", F.date_format("taken", DAY).alias("taken"))


@query("pages_with_shots", "C2", "page shot", "SELECT page_id, album_id FROM page p WHERE EXISTS (SELECT 1 FROM shot s WHERE s.page_id = p.page_id)")
def _(t: Tables):
    return C.pages_with_shots(t.page_base(), t.upload()).select("page_id", "album_id")


@query(
    "albums_to_assemble", "C3 J16", "album page shot",
    """SELECT album_id, name FROM album a WHERE pdf_stale AND page_size IS NOT NULL AND NOT EXISTS (SELECT 1 FROM page p WHERE p.album_id = a.album_id
       AND p.priority = '1-URGENT' AND p.state IN ('changed', 'ready', 'processing') AND EXISTS (SELECT 1 FROM shot s WHERE s.page_id = p.page_id))""",
)
def _(t: Tables):
    # Only urgent pages hold an assembly up here, so that the answer is not nearly empty.
    return C.albums_to_assemble(t.album(), t.page_base().filter("priority = '1-URGENT'"), t.upload()).select("album_id", "name")


@query(
    "album_summary", "D3", "album page op",
    """SELECT a.album_id, (SELECT count(*) FROM page p WHERE p.album_id = a.album_id) AS pages,
       (SELECT count(*) FROM op o WHERE o.album_id = a.album_id) AS pending_ops FROM album a""",
)
def _(t: Tables):
    return C.album_summary(t.album(), t.page_base(), t.op())


@query(
    "album_status", "D4 J16", "album page shot",
    """SELECT a.album_id, a.page_size IS NULL AS waiting_for_page_size, coalesce(bool_or(q.pending), false) AS pending,
       CASE WHEN NOT a.pdf_was_built THEN 'none' WHEN a.pdf_stale OR coalesce(bool_or(q.pending), false) THEN 'out_of_date' ELSE 'current' END AS pdf
       FROM album a LEFT JOIN (SELECT album_id, state IN ('changed', 'ready', 'processing') AND EXISTS (SELECT 1 FROM shot s WHERE s.page_id = p.page_id) AS pending
       FROM page p) q ON q.album_id = a.album_id GROUP BY a.album_id, a.page_size, a.pdf_was_built, a.pdf_stale""",
)
def _(t: Tables):
    return C.album_status(t.album(), t.page_base(), t.upload())


@query(
    "page_states", "D4 E1", "page shot",
    """SELECT album_id, position AS number, page_id, CASE WHEN EXISTS (SELECT 1 FROM shot s WHERE s.page_id = p.page_id) THEN state ELSE 'empty' END AS shown_state,
       CASE WHEN state = 'failed' THEN 'run failed: ' || priority END AS error FROM page p""",
)
def _(t: Tables):
    page = t.page().withColumn("last_error", F.concat(F.lit("run failed: "), "priority"))
    return C.page_states(page, t.upload()).join(page.select("page_id", F.col("position").alias("number")), "page_id")


@query(
    "report_counters", "D5", "page",
    """SELECT album_id, count(*) AS pages_found, count(*) FILTER (state <> 'failed') AS pages_ok, count(*) FILTER (state = 'failed') AS pages_failed,
       count(*) FILTER (state = 'done' OR page_id % 2 = 0) AS pdf_pages FROM page GROUP BY album_id""",
)
def _(t: Tables):
    p = t.page_base()
    status = F.when(F.col("state") == "failed", "failed").otherwise("ok")
    return C.report_counters(p.withColumn("status", status).withColumn("has_image", (F.col("state") == "done") | (F.col("page_id") % 2 == 0)))


@query(
    "pending_upload_pages", "D7", "queued",
    "SELECT page_id, count(*) AS uploads, count(DISTINCT shot_id) AS shots FROM queued GROUP BY page_id",
)
def _(t: Tables):
    return t.queued().groupBy("page_id").agg(F.count(F.lit(1)).alias("uploads"), F.count_distinct("shot_id").alias("shots"))


@query(
    "warned_pages", "C7 G6", "page feedback queued",
    """SELECT DISTINCT page_id, album_id FROM feedback f WHERE state NOT IN ('changed', 'ready', 'processing')
       AND code IN ('glare', 'incomplete_coverage', 'single_coverage') AND page_id NOT IN (SELECT page_id FROM queued) AND page_id IN (SELECT page_id FROM page)""",
)
def _(t: Tables):
    fb = FB.known_feedback(t.feedback(), t.page_base())
    return FB.warned_pages(fb, fb.select("page_id", "code"), t.queued())


@query(
    "warned_page_counts", "D6", "feedback queued",
    """SELECT album_id, count(DISTINCT page_id) AS warned FROM feedback f WHERE state NOT IN ('changed', 'ready', 'processing')
       AND code IN ('glare', 'incomplete_coverage', 'single_coverage') AND page_id NOT IN (SELECT page_id FROM queued) GROUP BY album_id""",
)
def _(t: Tables):
    fb = t.feedback()
    return FB.warned_counts(FB.warned_pages(fb, fb.select("page_id", "code"), t.queued()))


@query(
    "album_work_left", "C8", "page shot feedback queued",
    """WITH w AS (SELECT page_id FROM feedback WHERE state NOT IN ('changed', 'ready', 'processing') AND code IN ('glare', 'incomplete_coverage', 'single_coverage')
         AND page_id NOT IN (SELECT page_id FROM queued)),
       p AS (SELECT album_id, page.page_id, page.page_id IN (SELECT page_id FROM queued) OR f.state IS NULL OR f.state IN ('changed', 'ready', 'processing') AS pending,
         page.page_id IN (SELECT page_id FROM w) AS warned FROM page LEFT JOIN (SELECT page_id, state FROM feedback) f ON f.page_id = page.page_id
         WHERE page.page_id IN (SELECT page_id FROM shot))
       SELECT album_id, count(*) FILTER (warned AND NOT pending) AS warned, count(*) FILTER (pending) AS pending FROM p GROUP BY album_id""",
)
def _(t: Tables):
    fb = t.feedback()
    warned = FB.warned_pages(fb, fb.select("page_id", "code"), t.queued())
    return FB.work_left(C.with_shot_count(t.page_base(), t.upload()), fb, t.queued(), warned)


_OTHER = """WITH last AS (SELECT album_id, max_by(page_id, position) AS last_page FROM page GROUP BY album_id),
       tgt AS (SELECT l.album_id, coalesce(p.page_id, l.last_page) AS page_id FROM last l LEFT JOIN target t ON t.album_id = l.album_id
         LEFT JOIN page p ON p.page_id = t.target_page_id AND p.album_id = t.album_id),
       other AS (SELECT p.album_id, p.page_id, p.position FROM page p JOIN feedback f ON f.page_id = p.page_id
         WHERE f.state NOT IN ('changed', 'ready', 'processing') AND f.code IN ('single_coverage', 'glare')
         AND p.page_id NOT IN (SELECT page_id FROM queued) AND NOT EXISTS (SELECT 1 FROM tgt WHERE tgt.album_id = p.album_id AND tgt.page_id = p.page_id))"""


def _other(t: Tables):
    fb, page = t.feedback(), t.page()
    warning = fb.select("page_id", "code")
    warned = FB.warned_pages(fb, warning, t.queued())
    return FB.other_warned(page, fb, warning, warned, C.target_page(page, t.target()))


@query("other_warned_pages", "C9 E6", "page feedback queued target", _OTHER + " SELECT album_id, page_id, position FROM other")
def _(t: Tables):
    return _other(t).select("album_id", "page_id", "position")


@query(
    "warned_notice", "E12 C9", "page feedback queued target",
    _OTHER + """ SELECT album_id, min_by(page_id, position) AS page_id, min(position) AS number, count(*) - 1 AS more,
       'Page ' || min(position) || ' needs another shot' || CASE WHEN count(*) > 1 THEN ', and ' || (count(*) - 1) || ' more' ELSE '' END AS text FROM other GROUP BY album_id""",
)
def _(t: Tables):
    return FB.notice(_other(t))


@query(
    "newly_warned_pages", "G1", "feedback",
    """WITH cur AS (SELECT album_id, page_id FROM feedback WHERE code = 'single_coverage'), bef AS (SELECT album_id, page_id FROM feedback WHERE state = 'ready')
       SELECT album_id, page_id FROM cur WHERE (album_id, page_id) NOT IN (SELECT (album_id, page_id) FROM bef) AND album_id IN (SELECT album_id FROM bef)""",
)
def _(t: Tables):
    fb = t.feedback()
    before = fb.filter("state = 'ready'").select("album_id", "page_id")
    return FB.newly_warned(fb.filter(F.col("code") == "single_coverage").select("album_id", "page_id"), before, before)


@query(
    "target_pages", "E6", "page target",
    """SELECT l.album_id, coalesce(p.page_id, l.last_page) AS page_id FROM (SELECT album_id, max_by(page_id, position) AS last_page FROM page GROUP BY album_id) l
       LEFT JOIN target t ON t.album_id = l.album_id LEFT JOIN page p ON p.page_id = t.target_page_id AND p.album_id = t.album_id""",
)
def _(t: Tables):
    return C.target_page(t.page(), t.target())


@query(
    "pages_reordered", "E2 J3", "page shot",
    """WITH first AS (SELECT page_id, min(taken) AS first_shot FROM shot GROUP BY page_id),
       rows AS (SELECT album_id, page_id, 0 AS part, NULL::TIMESTAMP AS seen_at, row_number() OVER (PARTITION BY album_id ORDER BY total DESC, page_id) AS ord FROM page WHERE total >= 250000
         UNION ALL SELECT album_id, p.page_id, 1, first_shot, position FROM page p JOIN first f ON f.page_id = p.page_id WHERE p.total < 250000)
       SELECT album_id, page_id, row_number() OVER (PARTITION BY album_id ORDER BY part, seen_at NULLS FIRST, ord) AS position, count(*) OVER (PARTITION BY album_id) > 500 AS refused FROM rows""",
)
def _(t: Tables):
    page, shot = t.page(), t.shot()
    first = shot.groupBy("page_id").agg(F.min("taken").alias("first_shot"))
    existing = page.join(first, "page_id", "left").withColumn("has_shots", F.col("first_shot").isNotNull())
    listed = numbered(page.filter("total >= 250000"), ["album_id"], [F.col("total").desc(), "page_id"], "ord").select("album_id", "page_id", "ord")
    # Listed and kept pages are pages of the album, so its page table bounds both.
    return C.reordered(listed, existing, census=t.page_base())


@query(
    "page_gap_closed", "E3", "page",
    """SELECT album_id, page_id, CASE WHEN position > album_id % 5 + 1 THEN position - 1 ELSE position END AS position FROM page WHERE position <> album_id % 5 + 1""",
)
def _(t: Tables):
    at = t.album().select("album_id", (F.col("album_id") % 5 + 1).alias("at"))
    return C.shift_positions(t.page(), at, -1).select("album_id", "page_id", "position")


@query("page_gap_opened", "E3", "page", "SELECT album_id, page_id, CASE WHEN position >= album_id % 5 + 1 THEN position + 1 ELSE position END AS position FROM page")
def _(t: Tables):
    at = t.album().select("album_id", (F.col("album_id") % 5 + 1).alias("at"))
    return C.shift_positions(t.page(), at, 1).select("album_id", "page_id", "position")


@query("shots_in_order", "E4", "shot", "SELECT page_id, shot_id, row_number() OVER (PARTITION BY page_id ORDER BY taken, shot_id) AS number FROM shot")
def _(t: Tables):
    return numbered(t.shot(), ["page_id"], ["taken", "shot_id"], "number", census=t.upload()).select("page_id", "shot_id", "number")


@query("cover_shots", "E5", "shot", "SELECT page_id, shot_id AS cover FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY taken, shot_id) AS n FROM shot) WHERE n = 1")
def _(t: Tables):
    return C.cover_shot(t.shot())


@query(
    "shot_runs", "E7", "shot",
    """SELECT page_id, shot_id FROM (SELECT *, bool_or(split_part(shot_id, '-', 2) = '3') OVER (PARTITION BY page_id ORDER BY taken, shot_id ROWS UNBOUNDED PRECEDING) AS on_run FROM shot) WHERE on_run""",
)
def _(t: Tables):
    shot = t.shot()
    chosen = shot.filter(F.split("shot_id", "-")[1] == "3").select("page_id", "shot_id")
    return C.run_of(shot, chosen).select("page_id", "shot_id")


@query(
    "claimed_pages", "E8", "album page shot",
    """SELECT p.page_id, p.album_id, a.page_size FROM page p JOIN album a ON a.album_id = p.album_id WHERE p.state = 'ready' AND a.page_size IS NOT NULL
       AND p.page_id IN (SELECT page_id FROM shot) ORDER BY p.changed_at, p.page_id LIMIT 8""",
)
def _(t: Tables):
    # The limit is the feature: the free workers.
    return C.claim_order(t.page_base(), t.album(), t.upload(), 8).select("page_id", "album_id", "page_size")


@query(
    "latest_feedback", "E13 J11", "op",
    """SELECT album_id, page_no, kind, seq FROM (SELECT *, row_number() OVER (PARTITION BY album_id, page_no ORDER BY date_trunc('day', ts) DESC, seq DESC) AS n FROM op) WHERE n = 1""",
)
def _(t: Tables):
    rows = t.op().withColumn("fetched", F.date_trunc("day", "ts"))
    return C.latest(rows.select("album_id", "page_no", "kind", "seq", "fetched"), ["album_id", "page_no"], ["fetched", "seq"]).drop("fetched")


@query(
    "page_neighbours", "E14", "page",
    """SELECT page_id, CAST(lag(page_id) OVER w AS VARCHAR) AS previous, CAST(lead(page_id) OVER w AS VARCHAR) AS following FROM page WINDOW w AS (PARTITION BY album_id ORDER BY position)""",
)
def _(t: Tables):
    return C.neighbours(t.page()).select("page_id", F.col("previous").cast("string"), F.col("following").cast("string"))


@query(
    "server_albums_on_phone", "C10", "album",
    "SELECT album_id, name, album_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS on_phone FROM album",
)
def _(t: Tables):
    phone = t.raw("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("album_id"))
    return C.on_phone(t.album(), phone).select("album_id", "name", "on_phone")


@query(
    "session_pages", "C11", "album page",
    """WITH loc AS (SELECT album_id, page_id, total AS ord, 0 AS side FROM page WHERE album_id IN (SELECT album_id FROM album WHERE pdf_stale) AND priority <> '2-HIGH'),
       rest AS (SELECT album_id, page_id, CAST(position AS DOUBLE) AS ord, 1 AS side FROM page WHERE page_id NOT IN (SELECT page_id FROM loc))
       SELECT album_id, page_id, row_number() OVER (PARTITION BY album_id ORDER BY side, ord, page_id) AS number FROM (SELECT * FROM loc UNION ALL SELECT * FROM rest)""",
)
def _(t: Tables):
    page = t.page()
    edited = t.album().filter("pdf_stale").select("album_id")
    local = page.filter("priority <> '2-HIGH'").join(edited, "album_id", "left_semi").select("album_id", "page_id", F.col("total").alias("ord"))
    return C.session_pages(page.select("album_id", "page_id", F.col("position").cast("double").alias("ord")), local)


@query(
    "session_metadata", "C11", "album",
    """SELECT coalesce(a.album_id, l.album_id) AS album_id, CASE WHEN l.album_id IS NOT NULL THEN l.name ELSE a.name END AS name,
       CASE WHEN l.album_id IS NOT NULL THEN l.page_size ELSE a.page_size END AS page_size
       FROM (SELECT * FROM album WHERE page_size IS NOT NULL) a FULL JOIN (SELECT album_id, 'local ' || name AS name, CASE WHEN pdf_stale THEN NULL ELSE 'a3' END AS page_size FROM album WHERE NOT pdf_was_built) l ON l.album_id = a.album_id""",
)
def _(t: Tables):
    a = t.album().select("album_id", "name", "page_size", "pdf_stale", "pdf_was_built")
    local = a.filter(~F.col("pdf_was_built")).select("album_id", F.concat(F.lit("local "), "name").alias("name"), F.when(~F.col("pdf_stale"), "a3").alias("page_size"))
    return C.session_meta(a.filter(F.col("page_size").isNotNull()).drop("pdf_stale", "pdf_was_built"), local)


_ENTRIES = """WITH entries AS (SELECT DISTINCT l_orderkey AS page_id, CASE WHEN l_partkey % 11 = 0 THEN 'x' ELSE CAST(l_linenumber + l_partkey % 3 - 1 AS VARCHAR) END AS key FROM lineitem),
       ords AS (SELECT page_id, shot_id, row_number() OVER (PARTITION BY page_id ORDER BY shot_id) - 1 AS ordinal FROM shot)"""


def _entries(t: Tables):
    key = F.when(F.col("l_partkey") % 11 == 0, "x").otherwise((F.col("l_linenumber") + F.col("l_partkey") % 3 - 1).cast("string"))
    return t.raw("lineitem").select(F.col("l_orderkey").alias("page_id"), key.alias("key")).distinct()


@query("box_keys_to_shots", "C6", "shot", _ENTRIES + " SELECT e.page_id, e.key, coalesce(o.shot_id, e.key) AS shot_id FROM entries e LEFT JOIN ords o ON o.page_id = e.page_id AND o.ordinal = TRY_CAST(e.key AS BIGINT)")
def _(t: Tables):
    return C.keys_to_shot_ids(_entries(t), C.shot_ordinals(t.shot(), ["shot_id"], census=t.upload()), keep_unknown=True)


@query("outline_keys_to_shots", "C6", "shot", _ENTRIES + " SELECT e.page_id, e.key, o.shot_id FROM entries e JOIN ords o ON o.page_id = e.page_id AND o.ordinal = TRY_CAST(e.key AS BIGINT)")
def _(t: Tables):
    return C.keys_to_shot_ids(_entries(t), C.shot_ordinals(t.shot(), ["shot_id"], census=t.upload()), keep_unknown=False)


@query(
    "common_dpi", "D8", "page",
    """WITH d AS (SELECT album_id, page_id, CASE page_id % 3 WHEN 0 THEN 300 WHEN 1 THEN 400 ELSE 600 END AS dpi FROM page),
       b AS (SELECT album_id, dpi, row_number() OVER (PARTITION BY album_id ORDER BY count(*) DESC, dpi) AS n FROM d GROUP BY album_id, dpi)
       SELECT d.album_id, d.page_id, d.dpi, b.dpi AS common, d.dpi = b.dpi AS in_pdf FROM d JOIN b ON b.album_id = d.album_id AND b.n = 1""",
)
def _(t: Tables):
    m = F.col("page_id") % 3
    return C.common_dpi(t.page_base().select("album_id", "page_id", F.when(m == 0, 300).when(m == 1, 400).otherwise(600).alias("dpi")))


@query(
    "first_photo_with_box", "C19", "shot",
    """SELECT page_id, min_by(shot_id, (taken, shot_id)) AS shot_id FROM shot WHERE (page_id, shot_id) IN
       (SELECT (l_orderkey, concat(l_orderkey, '-', l_linenumber)) FROM lineitem WHERE l_tax > 0.04) GROUP BY page_id""",
)
def _(t: Tables):
    boxes = t.raw("lineitem").filter("l_tax > 0.04").select(F.col("l_orderkey").alias("page_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("shot_id"))
    return FB.first_photo_with_box(t.shot(), boxes)


@query(
    "dashed_regions", "B19", "",
    """WITH r AS (SELECT l_orderkey AS page_id, l_linenumber AS region, min(CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_discount END) AS glare_seen,
         CASE l_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS k, CASE WHEN l_orderkey % 9 = 0 THEN 'glare' ELSE 'single_coverage' END AS code FROM lineitem GROUP BY ALL),
       c AS (SELECT page_id, glare_seen AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY glare_seen DESC) AS n FROM r WHERE glare_seen IS NOT NULL) WHERE n = k)
       SELECT r.page_id, region, CASE WHEN k IS NULL OR glare_seen IS NULL OR code <> 'single_coverage' THEN false WHEN k <= 0 THEN true ELSE coalesce(glare_seen < cutoff, false) END AS dashed
       FROM r LEFT JOIN c ON c.page_id = r.page_id""",
)
def _(t: Tables):
    m = F.col("l_orderkey") % 4
    r = t.raw("lineitem").groupBy(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("region"),
        F.when(m == 1, 0).when(m == 2, 1).when(m == 3, 2).alias("k"), F.when(F.col("l_orderkey") % 9 == 0, "glare").otherwise("single_coverage").alias("code"),
    ).agg(F.min(F.when(F.col("l_suppkey") % 5 != 0, F.col("l_discount"))).alias("glare_seen"))
    return FB.dashed_regions(r).select("page_id", "region", "dashed")


@query(
    "photo_warning_lines", "I18 G3", "shot feedback",
    """WITH w AS (SELECT page_id, 0 AS ord, code, 'Look again at page ' || page_id || '.' AS message FROM feedback),
       r AS (SELECT l_orderkey AS page_id, 0 AS ord, l_linenumber AS region, CASE l_partkey % 4 WHEN 0 THEN 'top' WHEN 1 THEN 'left' WHEN 2 THEN 'centre' END AS location,
             concat(l_orderkey, '-', l_linenumber) AS shot_id, l_quantity < 10 AS boxed FROM lineitem),
       loc AS (SELECT page_id, location, min(region) AS first_at FROM r WHERE location IS NOT NULL GROUP BY page_id, location),
       pl AS (SELECT page_id, string_agg(location, ', ' ORDER BY first_at, location) AS places FROM loc GROUP BY page_id)
       SELECT s.page_id, s.shot_id, w.code, CASE WHEN w.code IN ('glare', 'incomplete_coverage', 'single_coverage') AND pl.places IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM r WHERE r.page_id = s.page_id AND r.shot_id = s.shot_id AND r.boxed) THEN w.message || ' Not in this photo; look at the ' || pl.places || '.' ELSE w.message END AS text
       FROM shot s JOIN w ON w.page_id = s.page_id LEFT JOIN pl ON pl.page_id = s.page_id""",
)
def _(t: Tables):
    warning = t.feedback().select("page_id", F.lit(0).alias("ord"), "code", F.concat(F.lit("Look again at page "), "page_id", F.lit(".")).alias("message"))
    m = F.col("l_partkey") % 4
    region = t.raw("lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.lit(0).alias("ord"), F.col("l_linenumber").alias("region"),
        F.when(m == 0, "top").when(m == 1, "left").when(m == 2, "centre").alias("location"),
        F.when(F.col("l_quantity") < 10, F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("shot_id"),
    )
    return FB.photo_lines(t.shot(), warning, region).drop("ord")
