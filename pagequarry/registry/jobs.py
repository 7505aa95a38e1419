"""Batch-run, integrity and assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..mappings import Tables
from ..plans import album_run as RUN
from ..plans import upkeep as UP
from ..sources.inventory import roles
from . import query
from .grid import sql_regions


def _files(t: Tables):
    """The photo files of the data folder: some lie under another page, some have changed."""
    li, o = t.raw("lineitem"), t.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    f = li.join(o, "l_orderkey")
    page = F.when(F.col("l_tax") > 0.07, F.col("l_orderkey") + 1).otherwise(F.col("l_orderkey"))
    name = F.concat_ws("-", "l_orderkey", "l_linenumber")
    # Rows are told apart by what paths and hashes are made of; those are made after the shuffle. Without album or page there is no path.
    place = F.when(F.col("o_custkey").isNotNull() & page.isNotNull(), F.struct(F.col("o_custkey").alias("album"), page.alias("page"), name.alias("name")))
    once = f.select(place.alias("at"), F.when(F.col("l_discount") > 0.09, "changed").otherwise(name).alias("content")).distinct()
    path = F.concat(F.lit("/data/albums/"), "at.album", F.lit("/photos/"), "at.page", F.lit("/"), "at.name", F.lit(".jpg"))
    return once.select(path.alias("path"), F.sha2("content", 256).alias("sha"))


_FILES = """fi AS (SELECT DISTINCT o_custkey AS album_id, CASE WHEN l_tax > 0.07 THEN l_orderkey + 1 ELSE l_orderkey END AS page_id, concat(l_orderkey, '-', l_linenumber) AS shot_id,
    CASE WHEN l_discount > 0.09 THEN sha256('changed') ELSE sha256(concat(l_orderkey, '-', l_linenumber)) END AS sha FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    ix AS (SELECT DISTINCT o_custkey AS album_id, l_orderkey AS page_id, concat(l_orderkey, '-', l_linenumber) AS shot_id, sha256(concat(l_orderkey, '-', l_linenumber)) AS sha FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _indexed(t: Tables):
    o = t.raw("orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("album_id"))
    # A hash follows from the shot's id: it is made where the photos are compared.
    once = t.upload().select("page_id", "shot_id").repartition("page_id").distinct().join(o, "page_id")
    return once.repartition(*UP.KEY).select("page_id", "shot_id", F.sha2("shot_id", 256).alias("sha"), "album_id")


@query(
    "integrity_report", "C4 C5 I15 A7 B7", "",
    f"""WITH {_FILES} SELECT 'missing' AS kind, album_id, page_id, shot_id FROM ix WHERE (album_id, page_id, shot_id) NOT IN (SELECT (album_id, page_id, shot_id) FROM fi)
       UNION ALL SELECT 'extra', album_id, page_id, shot_id FROM fi WHERE (album_id, page_id, shot_id) NOT IN (SELECT (album_id, page_id, shot_id) FROM ix)
       UNION ALL SELECT 'changed', ix.album_id, ix.page_id, ix.shot_id FROM ix JOIN fi ON fi.album_id = ix.album_id AND fi.page_id = ix.page_id AND fi.shot_id = ix.shot_id WHERE fi.sha <> ix.sha""",
)
def _(t: Tables):
    f = roles(_files(t)).filter("role = 'photo'").select(F.col("album_id").cast("bigint"), F.col("page_id").cast("bigint"), F.col("name").alias("shot_id"), "sha")
    return UP.integrity(_indexed(t), f)


@query(
    "album_assembly", "I16 D8 E1", "page shot",
    """WITH p AS (SELECT *, CASE WHEN priority <> '2-HIGH' THEN 'out/' || page_id END AS print_path, CASE WHEN total > 20000 THEN CASE WHEN page_id % 4 = 0 THEN 600 ELSE 300 END END AS dpi, total < 400000 AS file_there FROM page),
       w AS (SELECT *, CASE WHEN page_id NOT IN (SELECT page_id FROM shot) THEN 'no shots' WHEN state = 'failed' THEN 'failed' WHEN print_path IS NULL THEN 'no print' WHEN dpi IS NULL THEN 'no report' WHEN NOT file_there THEN 'file missing' END AS why FROM p),
       c AS (SELECT album_id, dpi AS common FROM (SELECT album_id, dpi, row_number() OVER (PARTITION BY album_id ORDER BY count(*) DESC, dpi) AS n FROM w WHERE why IS NULL GROUP BY album_id, dpi) WHERE n = 1)
       SELECT w.album_id, position AS number, page_id, CASE WHEN why IS NULL AND dpi <> common THEN 'other dpi' ELSE why END AS why, why IS NULL AND dpi = common AS in_pdf FROM w LEFT JOIN c ON c.album_id = w.album_id""",
)
def _(t: Tables):
    p = t.page().withColumn("print_path", F.when(F.col("priority") != "2-HIGH", F.concat(F.lit("out/"), "page_id")))
    report = t.page_base().filter("total > 20000").select("page_id", F.when(F.col("page_id") % 4 == 0, 600).otherwise(300).alias("dpi"))
    printed = t.page_base().filter("total < 400000").select(F.concat(F.lit("out/"), "page_id").alias("print_path"))
    return UP.assembly(p, t.upload(), report, printed)


@query(
    "album_run_decisions", "I1 C12 B9", "page shot",
    """WITH k AS (SELECT page_id, count(*) AS n FROM shot GROUP BY page_id),
       s AS (SELECT p.album_id, p.page_id, k.n IS NULL AS problem, p.priority = '2-HIGH' AS changed_photos, p.priority = '3-MEDIUM' AS resized, p.state = 'failed' AS lost FROM page p LEFT JOIN k ON k.page_id = p.page_id)
       SELECT album_id, page_id, CASE WHEN problem THEN 'failed' WHEN changed_photos OR lost THEN 'process' WHEN resized THEN 'reprint' ELSE 'reuse' END AS decision FROM s""",
)
def _(t: Tables):
    lists = RUN.photo_lists(t.shot().select("page_id", F.col("shot_id").alias("photo"), "sha"))
    pages = t.page_base().join(lists, "page_id", "left")
    folder = F.concat(F.lit("page-"), "page_id")

    def spec(shas, size):
        s = pages.select(
            "album_id", "page_id", folder.alias("folder"), F.when(F.col("shas").isNull(), "no photos").alias("problem"), shas.alias("shas"), F.lit("auto").alias("page_options"),
            size.alias("size"), F.lit("300 dpi").alias("print_options"), F.lit(0.99).alias("coverage"), F.concat(F.lit("pages/"), folder).alias("processed"), F.concat(F.lit("print/"), folder).alias("print"),
            (F.col("state") != "failed").alias("processed_exists"), F.lit(True).alias("print_exists"),
        )
        return RUN.with_keys(s, "1")

    now = spec(F.col("shas"), F.lit("letter"))
    before = spec(F.when(F.col("priority") == "2-HIGH", F.array(F.lit("old"))).otherwise(F.col("shas")), F.when(F.col("priority") == "3-MEDIUM", "a4").otherwise("letter"))
    return RUN.decide(now.drop("processed_exists", "print_exists"), before).select("album_id", "page_id", "decision")


@query(
    "album_run_results", "I1 K1 D5", "page shot",
    """WITH k AS (SELECT page_id, count(*) AS n, sum(bytes) AS total FROM shot GROUP BY page_id)
       SELECT p.album_id, p.page_id, CASE WHEN k.n IS NULL OR k.total > 200 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN k.n IS NULL THEN 'no photos' WHEN k.total > 200 THEN 'page too large' END AS error,
         CAST(CASE WHEN k.total <= 200 THEN k.n END AS VARCHAR) AS photos FROM page p LEFT JOIN k ON k.page_id = p.page_id""",
)
def _(t: Tables):
    import numpy as np
    import pandas as pd

    shot = t.shot()
    has = shot.select("page_id", F.lit(True).alias("_has")).distinct()
    decided = t.page_base().select("album_id", "page_id").join(has, "page_id", "left").select(
        "album_id", "page_id", F.when(F.col("_has").isNull(), "no photos").alias("problem"), F.when(F.col("_has").isNull(), "failed").otherwise("process").alias("decision")
    )

    def runner(pdf: pd.DataFrame) -> dict:
        if np.nansum(pdf["bytes"].to_numpy()) > 200:
            raise RuntimeError("page too large")
        return {"page_id": pdf["page_id"].iloc[0], "photos": len(pdf)}

    out = RUN.run_album(decided, shot.select("page_id", "bytes"), runner, "page_id long, photos long")
    return out.select("album_id", "page_id", "status", "error", F.col("photos").cast("string"))


# Pages in order of their place in the album: folders missing or empty, pages that fail when run or when printed, pages reprinted or reused.
_ENTRIES = """b AS (SELECT album_id, page_id, row_number() OVER (PARTITION BY album_id ORDER BY page_id) AS index, priority = '2-HIGH' AND page_id % 3 = 0 AS missing, priority FROM page),
       k AS (SELECT page_id, sum(bytes) AS total FROM shot GROUP BY page_id),
       f AS (SELECT b.*, CASE WHEN missing THEN 'folder ''p-' || b.page_id || ''' not found' WHEN k.page_id IS NULL THEN 'no photos in ''p-' || b.page_id || '''' END AS problem, k.total AS bytes FROM b LEFT JOIN k ON k.page_id = b.page_id),
       r AS (SELECT *, CASE WHEN problem IS NOT NULL THEN 'failed' WHEN priority IN ('1-URGENT', '4-NOT SPECIFIED') THEN 'process' WHEN priority = '3-MEDIUM' THEN 'reprint' ELSE 'reuse' END AS decision FROM f),
       e AS (SELECT *, CASE WHEN problem IS NOT NULL THEN problem WHEN decision = 'process' AND bytes > 200 THEN 'page too large' WHEN decision IN ('process', 'reprint') AND page_id % 11 = 0 THEN 'ValueError: cannot print' END AS error FROM r),
       s AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'failed' ELSE CASE decision WHEN 'process' THEN 'ok' WHEN 'reprint' THEN 'reprinted' ELSE 'reused' END END AS status FROM e)"""


def _entries(t: Tables, strict: bool):
    import numpy as np
    import pandas as pd

    from ..operators.ordered import numbered

    base = numbered(t.page_base(), ["album_id"], ["page_id"], "index").withColumn("folder", F.concat(F.lit("p-"), "page_id"))
    shot = t.shot().join(base.select("page_id"), "page_id")
    filled = t.upload().select("page_id").distinct().join(base.select("page_id", "album_id", "folder"), "page_id")
    gone = (F.col("priority") == "2-HIGH") & (F.col("page_id") % 3 == 0)
    p = RUN.with_problems(base.select("album_id", "page_id", "folder", "index", "priority"), base.filter(~gone), filled)
    decision = F.when(F.col("problem").isNotNull(), "failed").when(F.col("priority").isin("1-URGENT", "4-NOT SPECIFIED"), "process").when(F.col("priority") == "3-MEDIUM", "reprint").otherwise("reuse")
    decided = p.select("album_id", "page_id", "folder", "index", "problem", decision.alias("decision"))

    def runner(pdf: pd.DataFrame) -> dict:
        if np.nansum(pdf["bytes"].to_numpy()) > 200:
            raise RuntimeError("page too large")
        return {"page_id": pdf["page_id"].iloc[0], "photos": len(pdf)}

    def printer(pdf: pd.DataFrame) -> dict:
        page = pdf["page_id"].iloc[0]
        if page % 11 == 0:
            raise ValueError("cannot print")
        return {"page_id": page, "printed": True}

    entries = RUN.run_album(decided, shot.select("page_id", "bytes"), runner, "page_id long, photos long", printer=printer, print_schema="page_id long, printed boolean", strict=strict)
    return RUN.recorded(entries.select("album_id", "page_id", "folder", F.col("index").cast("bigint").alias("index"), "status", "error"), strict)


@query("album_run_entries", "I1 K1 A3", "page shot", "WITH " + _ENTRIES + " SELECT album_id, page_id, index, status, error, CASE WHEN status = 'failed' THEN 'placeholder' ELSE 'print' END || '/p-' || page_id AS image FROM s")
def _(t: Tables):
    return _entries(t, False).drop("folder")


@query(
    "album_run_strict", "I1 K1", "page shot",
    "WITH " + _ENTRIES + """, z AS (SELECT album_id, min(index) AS stop FROM s WHERE status = 'failed' GROUP BY album_id)
       SELECT s.album_id, page_id, index, CASE WHEN index > stop THEN 'stopped' ELSE status END AS status, CASE WHEN index > stop THEN NULL ELSE error END AS error,
         CASE WHEN index > stop OR status = 'failed' THEN NULL ELSE 'print/p-' || page_id END AS image FROM s LEFT JOIN z ON z.album_id = s.album_id""",
)
def _(t: Tables):
    return _entries(t, True).drop("folder")


@query(
    "album_run_pdfs", "I1 D8", "page shot",
    "WITH " + _ENTRIES + " SELECT album_id, string_agg(CASE WHEN status = 'failed' THEN 'placeholder' ELSE 'print' END || '/p-' || page_id, ',' ORDER BY index) AS images, CAST(count(*) AS INTEGER) AS pages FROM s GROUP BY album_id",
)
def _(t: Tables):
    return RUN.pdf_pages(_entries(t, False)).select("album_id", F.array_join("images", ",").alias("images"), "pages")


@query(
    "manifest_rejects", "A3 G4", "",
    """SELECT CAST(c_custkey AS VARCHAR) AS album, CASE c_custkey % 5 WHEN 0 THEN 'unknown key(s) colour' WHEN 1 THEN 'page_size: cannot be parsed' WHEN 2 THEN 'folder ''p1'' is listed twice' ELSE 'pages[1]: rotate: not a choice' END AS error
       FROM customer WHERE c_custkey % 5 <> 4""",
)
def _(t: Tables):
    from ..sources.manifest import manifest_pages

    k = F.col("c_custkey") % 5
    text = (
        F.when(k == 0, '{"title": "a", "colour": 1, "pages": ["p1"]}').when(k == 1, '{"page_size": "10x", "pages": ["p1"]}').when(k == 2, '{"pages": ["p1", {"folder": "p1"}]}')
        .when(k == 3, '{"pages": ["p1", {"folder": "p2", "rotate": 45}]}').otherwise('{"title": "good", "page_size": "a4", "pages": ["p1", {"folder": "p2", "name": "Two", "rotate": 90}]}')
    )
    return manifest_pages(t.raw("customer").select(F.col("c_custkey").cast("string").alias("album"), text.alias("text")))[1]


@query(
    "manifest_pages", "A3 B4", "",
    """SELECT CAST(c_custkey AS VARCHAR) AS album, i AS index, 'p' || i AS folder, CASE i WHEN 1 THEN 'p1' ELSE 'Two' END AS name, CASE i WHEN 1 THEN 0 ELSE 90 END AS rotate, round(210 / 25.4, 4) AS a_in
       FROM customer, (SELECT unnest([1, 2]) AS i) WHERE c_acctbal >= 0""",
)
def _(t: Tables):
    from ..sources.manifest import manifest_pages

    text = F.when(F.col("c_acctbal") < 0, "{").otherwise('{"title": "good", "page_size": "a4", "pages": ["p1", {"folder": "p2", "name": "Two", "rotate": 90}]}')
    p = manifest_pages(t.raw("customer").select(F.col("c_custkey").cast("string").alias("album"), text.alias("text")))[0]
    return p.select("album", "index", "folder", "name", "rotate", F.round(p["size"]["a_in"], 4).alias("a_in"))


@query("page_quality_warnings", "I2 B13 D16 D17", "")
def _(t: Tables):
    from ..mappings import GRID_H, GRID_W
    from ..plans.quality import assess

    c = t.cell().select("page_id", "shot", "y", "x", (F.col("r") + 1).cast("double").alias("weight"), (F.col("score") / 100).alias("glare"), (F.col("b") / 256).alias("shadow"))
    return assess(c, GRID_W, GRID_H, 1000, 800, threshold=0.75, min_region=0.01).warnings


# In 128ths and 256ths and with whole weights, so that means are exact in any order.
_FRACTIONS = """u AS (SELECT page_id, y, x, count(DISTINCT shot) AS shots, CAST(sum((r + 1) * score) AS DOUBLE) / 128 / CAST(sum(r + 1) AS DOUBLE) AS glare, CAST(sum((r + 1) * b) AS DOUBLE) / 256 / CAST(sum(r + 1) AS DOUBLE) AS shadow FROM cell GROUP BY ALL)
       SELECT page_id, round_even(count(*) / 500.0::DOUBLE, 4) AS covered, round_even(1 - count(*) / 500.0::DOUBLE, 4) AS uncovered, round_even(count(*) FILTER (shots = 1) / count(*), 4) AS single,
         round_even(count(*) FILTER (glare >= 0.5) / count(*), 4) AS glare, round_even(count(*) FILTER (shadow >= 0.5) / count(*), 4) AS shadow FROM u GROUP BY page_id"""


def _assessed(cells):
    from ..mappings import GRID_H, GRID_W
    from ..plans.quality import assess

    c = cells.select("page_id", "shot", "y", "x", (F.col("r") + 1).cast("double").alias("weight"), (F.col("score") / 128).alias("glare"), (F.col("b") / 256).alias("shadow"))
    return assess(c, GRID_W, GRID_H, 1000, 800, threshold=0.5, min_region=0.01)


@query("page_quality_fractions", "I2 D16 D17", "cell", "WITH " + _FRACTIONS)
def _(t: Tables):
    return _assessed(t.cell()).fractions


@query(
    "glare_payloads", "I2 B13 B17 D22", "cell",
    f"""WITH RECURSIVE u AS (SELECT page_id, y, x, count(DISTINCT shot) AS shots, CAST(sum((r + 1) * score) AS DOUBLE) / 128 / CAST(sum(r + 1) AS DOUBLE) AS glare FROM cell GROUP BY ALL),
        src AS (SELECT page_id, y, x FROM u WHERE glare >= 0.5), {sql_regions('src', 0.01)},
        why AS (SELECT rc.page_id, rc.component, count(*) FILTER (shots = 1) > 0.5 * count(*) AS single FROM rc LEFT JOIN u ON u.page_id = rc.page_id AND u.y = rc.y AND u.x = rc.x GROUP BY ALL),
        who AS (SELECT page_id, component, string_agg(CAST(shot AS VARCHAR), ',' ORDER BY shot) AS seen_by FROM (SELECT DISTINCT rc.page_id, rc.component, c.shot FROM rc JOIN cell c ON c.page_id = rc.page_id AND c.y = rc.y AND c.x = rc.x) GROUP BY ALL),
        px AS (SELECT page_id, component, x0 * 40 AS a, y0 * 40 AS b, x1 * 40 AS c, y1 * 40 AS d FROM rs), k AS (SELECT unnest(range(9)) / 8.0::DOUBLE AS v),
        o AS (SELECT page_id, component, a + v * (c - a) AS x, b::DOUBLE AS y FROM px, k UNION ALL SELECT page_id, component, a + v * (c - a), d FROM px, k UNION ALL SELECT page_id, component, a, b + v * (d - b) FROM px, k UNION ALL SELECT page_id, component, c, b + v * (d - b) FROM px, k),
        m AS (SELECT o.page_id, component, shot, (x - 20.0::DOUBLE * shot) / (0.0001::DOUBLE * shot * x + 1) AS mx, (y - 10.0::DOUBLE * shot) / (0.0001::DOUBLE * shot * x + 1) AS my FROM o JOIN (SELECT DISTINCT page_id, shot FROM cell) s ON s.page_id = o.page_id),
        g AS (SELECT page_id, component, shot, CAST(greatest(floor(min(mx)), 0) AS INTEGER) AS a, CAST(greatest(floor(min(my)), 0) AS INTEGER) AS b, CAST(least(ceil(max(mx)), 699) AS INTEGER) AS c, CAST(least(ceil(max(my)), 499) AS INTEGER) AS d FROM m GROUP BY ALL),
        bx AS (SELECT page_id, component, string_agg(concat(shot, ':', a, ',', b, ',', c, ',', d), ' ' ORDER BY shot) AS boxes FROM g WHERE c > a AND d > b GROUP BY ALL),
        one AS (SELECT rs.page_id, row_number() OVER (PARTITION BY rs.page_id ORDER BY pixels DESC, y0, x0, rs.component) AS ord, single, location,
          concat_ws('/', concat_ws(',', px.a, px.b, px.c, px.d), location, CASE WHEN single THEN 'single_shot' ELSE 'all_shots_glared' END, coalesce(seen_by, ''), coalesce(boxes, '')) AS t
          FROM rs JOIN px ON px.page_id = rs.page_id AND px.component = rs.component JOIN why ON why.page_id = rs.page_id AND why.component = rs.component LEFT JOIN who ON who.page_id = rs.page_id AND who.component = rs.component LEFT JOIN bx ON bx.page_id = rs.page_id AND bx.component = rs.component)
        SELECT one.page_id, min(f.fraction) AS fraction, count(*) FILTER (single) AS single_shot, count(*) FILTER (NOT single) AS all_shots, min_by(location, ord) AS location, string_agg(t, '|' ORDER BY ord) AS regions
        FROM one JOIN (SELECT page_id, round_even(count(*) FILTER (glare >= 0.5) / count(*), 4) AS fraction FROM u GROUP BY page_id) f ON f.page_id = one.page_id GROUP BY one.page_id""",
)
def _(t: Tables):
    # Shots lie a little off the page's frame and are seen at a slant.
    from ..plans.quality import payloads

    n = F.col("shot").cast("double")
    h = F.array(F.lit(1.0), F.lit(0.0), -20.0 * n, F.lit(0.0), F.lit(1.0), -10.0 * n, 0.0001 * n, F.lit(0.0), F.lit(1.0))
    mappers = t.cell().select("page_id", "shot").distinct().select("page_id", "shot", h.alias("h"), F.lit(700).alias("width"), F.lit(500).alias("height"))
    text = lambda c: F.transform(c, lambda v: v.cast("string"))
    boxes = lambda r: F.array_join(F.transform(F.array_sort(F.map_keys(r["shot_boxes"])), lambda s: F.concat(s.cast("string"), F.lit(":"), F.array_join(text(r["shot_boxes"][s]), ","))), " ")
    region = lambda r: F.concat_ws("/", F.array_join(text(r["bbox_px"]), ","), r["location"], r["cause"], F.array_join(text(r["shots"]), ","), boxes(r))
    p = payloads(_assessed(t.cell()), mappers).filter("code = 'glare'")
    return p.select("page_id", "fraction", "single_shot", "all_shots", "location", F.array_join(F.transform("regions", region), "|").alias("regions"))


@query("published_fractions", "I2 A12", "cell", "WITH " + _FRACTIONS)
def _(t: Tables):
    # Ready pages as a stream; each trigger's pages are assessed and published as one run.
    from ..sources.sinks import Published
    from ..streaming.stateful import work_folder

    ready = t.spark.readStream.schema(t.raw("supplier").schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "supplier.parquet").parquet(t.dir).select(F.col("s_suppkey").alias("page_id"))
    root = work_folder(t.spark, "published")
    shelf = Published(t.spark, f"{root}/shelf")
    shelf.publish_stream(ready, lambda pages: _assessed(t.cell().join(pages, "page_id", "left_semi")).fractions, f"{root}/checkpoint")
    shelf.compact()
    return shelf.read().drop("run")


@query(
    "page_options", "B24 B23", "",
    """SELECT o_orderkey AS page_id, coalesce(CASE o_orderkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'force' END, 'auto') AS curvature, coalesce(CASE WHEN o_custkey % 2 = 0 THEN 'left' END, 'auto') AS binding,
       coalesce(CASE WHEN o_orderstatus = 'F' THEN 'off' END, 'auto') AS sleeve, coalesce(CASE WHEN o_orderstatus = 'O' THEN 'sleeve' END, 'paper') AS crop FROM orders""",
)
def _(t: Tables):
    from ..functions.pages import page_options

    k, status = F.col("o_orderkey") % 3, F.col("o_orderstatus")
    own = {"curvature": F.when(k == 0, "off").when(k == 1, "force"), "binding": F.when(F.col("o_custkey") % 2 == 0, "left"), "sleeve": F.when(status == "F", "off"), "crop": F.when(status == "O", "sleeve")}
    opt = page_options(own, {"curvature": "auto", "binding": "auto", "sleeve": "auto", "crop": "paper"})
    return t.raw("orders").select(F.col("o_orderkey").alias("page_id"), *[c.alias(n) for n, c in opt.items()])
