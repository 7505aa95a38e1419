"""Queries on taken times, sessions, files to remove, splits, coarse labels and the release gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..mappings import Tables
from ..operators import catalog as C
from ..operators import evaluate as EV
from ..operators import grid as G
from ..operators import replay as RP
from ..operators.ordered import numbered
from ..plans import upkeep as UP
from . import query


@query(
    "shots_by_taken_and_arrival", "B20 E4", "",
    """WITH s AS (SELECT l_orderkey AS page_id, concat(l_orderkey, '-', l_linenumber) AS shot_id, l_shipdate + INTERVAL (CAST(l_partkey % 30 AS INTEGER)) DAY AS received, l_suppkey AS seq,
         CASE WHEN l_quantity >= 12 THEN l_shipdate END AS exif FROM lineitem), t AS (SELECT *, coalesce(exif, received) AS taken FROM s)
       SELECT page_id, shot_id, strftime(taken, '%Y-%m-%d') AS taken, row_number() OVER (PARTITION BY page_id ORDER BY taken, received, seq, shot_id) AS number FROM t""",
)
def _(t: Tables):
    days = (F.col("l_partkey") % 30).cast("int")
    s = t.raw("lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("shot_id"), F.date_add(F.col("l_shipdate").cast("date"), days).alias("received"),
        F.col("l_suppkey").alias("seq"), F.when(F.col("l_quantity") >= 12, F.col("l_shipdate").cast("date")).alias("exif"),
    )
    s = s.withColumn("taken", C.taken_time(F.col("exif"), F.col("received")))
    n = numbered(s, ["page_id"], ["taken", "received", "seq", "shot_id"], "number", census=t.raw("lineitem").select(F.col("l_orderkey").alias("page_id")))
    return n.select("page_id", "shot_id", F.date_format("taken", "yyyy-MM-dd").alias("taken"), "number")


@query(
    "session_shots", "C11", "",
    """WITH l AS (SELECT l_orderkey AS page_id, concat(l_orderkey, '-', l_linenumber) AS shot_id, l_linenumber AS ord, l_quantity AS q FROM lineitem), sv AS (SELECT DISTINCT page_id, shot_id, ord FROM l WHERE q < 35), lo AS (SELECT DISTINCT page_id, shot_id, ord FROM l WHERE q >= 20),
       un AS (SELECT DISTINCT shot_id FROM l WHERE q >= 30), r AS (SELECT *, 0 AS side FROM sv UNION ALL SELECT *, 1 FROM lo WHERE shot_id IN (SELECT shot_id FROM un) AND (page_id, shot_id) NOT IN (SELECT (page_id, shot_id) FROM sv))
       SELECT page_id, shot_id, row_number() OVER (PARTITION BY page_id ORDER BY side, ord, shot_id) AS number, side = 1 AS unsent FROM r""",
)
def _(t: Tables):
    l = t.raw("lineitem").select(F.col("l_orderkey").alias("page_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("shot_id"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("q"))  # noqa: E741
    side = lambda where: l.filter(where).drop("q").distinct()
    return C.session_shots(side("q < 35"), side("q >= 20"), l.filter("q >= 30").select("shot_id"))


@query(
    "removable_files", "C4", "",
    """WITH f AS (SELECT concat(l_orderkey, '/', l_linenumber, '/', l_partkey) AS path, l_suppkey * 7 AS album_id, l_orderkey AS page_id, concat('s', l_partkey % 50) AS name, l_linenumber AS run,
         ['photo', 'thumb', 'output', 'work', 'temporary', 'outside', 'photo'][l_linenumber] AS role FROM lineitem), a AS (SELECT s_suppkey * 7 AS album_id FROM supplier WHERE s_acctbal > 0),
       pg AS (SELECT DISTINCT l_suppkey * 7 AS album_id, l_orderkey AS page_id, 3 AS run FROM lineitem WHERE l_discount > 0.05), sh AS (SELECT DISTINCT l_suppkey * 7 AS album_id, l_orderkey AS page_id, concat('s', l_partkey % 50) AS shot_id FROM lineitem WHERE l_tax > 0.03)
       SELECT path, role FROM f WHERE role <> 'outside' AND (album_id NOT IN (SELECT album_id FROM a) OR role IN ('work', 'temporary')
         OR role = 'photo' AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.album_id = f.album_id AND sh.page_id = f.page_id AND sh.shot_id = f.name) OR role = 'thumb' AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.album_id = f.album_id AND sh.shot_id = f.name)
         OR role = 'output' AND NOT EXISTS (SELECT 1 FROM pg WHERE pg.album_id = f.album_id AND pg.page_id = f.page_id AND pg.run = f.run))""",
)
def _(t: Tables):
    li = t.raw("lineitem")
    album, page, name = (F.col("l_suppkey") * 7).alias("album_id"), F.col("l_orderkey").alias("page_id"), F.concat(F.lit("s"), F.col("l_partkey") % 50)
    roles = F.array(*[F.lit(r) for r in ("photo", "thumb", "output", "work", "temporary", "outside", "photo")])
    files = li.select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("path"), album, page, name.alias("name"), F.col("l_linenumber").alias("run"), F.element_at(roles, F.col("l_linenumber").cast("int")).alias("role"))
    albums = t.raw("supplier").filter("s_acctbal > 0").select((F.col("s_suppkey") * 7).alias("album_id"))
    pages = li.filter("l_discount > 0.05").select(album, page, F.lit(3).alias("run")).distinct()
    shots = li.filter("l_tax > 0.03").select(album, page, name.alias("shot_id")).distinct()
    return UP.removable(files, albums, pages, shots)


@query(
    "split_rates", "E16 D25", "",
    """WITH s AS (SELECT DISTINCT source AS page, CASE WHEN source LIKE '%7' THEN 'validation' WHEN source LIKE '%3' THEN 'test' END AS split FROM documents),
       r AS (SELECT coalesce(s.split, 'train') AS split, toxic = 1 AS p, quality AS l FROM labels JOIN documents USING (doc_id) JOIN s ON s.page = source)
       SELECT coalesce(split, 'all') AS split, round(count(*) FILTER (p AND l = 1) / greatest(count(*) FILTER (l = 1), 1), 6) AS recall, round(count(*) FILTER (p AND l = 0) / greatest(count(*) FILTER (l = 0), 1), 6) AS false_alarms,
         round(count(*) FILTER (l = 1) / greatest(count(*) FILTER (l IN (0, 1)), 1), 6) AS glare_share FROM r GROUP BY GROUPING SETS ((split), ())""",
)
def _(t: Tables):
    docs = t.raw("documents").select("doc_id", F.col("source").alias("page"))
    named = docs.select("page").distinct().withColumn("split", F.when(F.col("page").endswith("7"), "validation").when(F.col("page").endswith("3"), "test")).filter("split IS NOT NULL")
    rows = t.raw("labels").join(docs, "doc_id").select("page", (F.col("toxic") == 1).alias("pred"), F.col("quality").alias("label"))
    p = EV.pooled_rates(EV.split_samples(rows, named), "split")
    return p.select(F.coalesce("split", F.lit("all")).alias("split"), *[F.round(c, 6).alias(c) for c in ("recall", "false_alarms", "glare_share")])


@query(
    "labels_shrunk", "H5", "cell",
    """WITH c AS (SELECT page_id, shot, y, x, CASE WHEN score >= 70 THEN 1 WHEN score >= 10 THEN 0 END AS label FROM cell),
       a AS (SELECT page_id, shot, CAST(y // 3 AS INTEGER) AS y, CAST(x // 3 AS INTEGER) AS x, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS g, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS c, least(3, 20 - (y // 3) * 3) * least(3, 25 - (x // 3) * 3) AS n FROM c GROUP BY page_id, shot, y // 3, x // 3)
       SELECT page_id, shot, y, x, CASE WHEN g / n >= 0.5 THEN 1 WHEN c / n >= 0.75 THEN 0 END AS label FROM a""",
)
def _(t: Tables):
    c = t.cell().withColumn("label", F.when(F.col("score") >= 70, 1).when(F.col("score") >= 10, 0))
    return G.shrunk_labels(c, ["page_id", "shot"], 3, 25, 20)


@query(
    "release_gate", "D29", "",
    """WITH re AS (SELECT l_suppkey AS detector, CAST(floor(l_quantity / 2) AS BIGINT) AS single, CAST(floor(l_quantity / 2.2) AS BIGINT) AS r2, CAST(floor(l_quantity) AS BIGINT) AS g, CAST(floor(l_quantity * l_discount) AS BIGINT) AS o FROM lineitem),
       d AS (SELECT detector, sum(r2) / sum(single) AS removed, sum(o) / sum(g) AS unwarned FROM re GROUP BY detector)
       SELECT detector, round(removed, 6) AS removed, round(unwarned, 6) AS unwarned, removed >= 0.8 AND unwarned <= 0.1 AS pass FROM d""",
)
def _(t: Tables):
    q = F.col("l_quantity")
    rows = t.raw("lineitem").select(F.col("l_suppkey").alias("detector"), F.floor(q / 2).alias("single"), F.floor(q / 2.2).alias("r2"), F.floor(q).alias("g"), F.floor(q * F.col("l_discount")).alias("o"))
    removed = rows.groupBy("detector").agg((F.sum("r2") / F.sum("single")).alias("removed"))
    unwarned = rows.groupBy("detector").agg((F.sum("o") / F.sum("g")).alias("unwarned"))
    d = removed.join(unwarned, "detector")
    return d.select("detector", F.round("removed", 6).alias("removed"), F.round("unwarned", 6).alias("unwarned"), RP.gate(F.col("removed"), F.col("unwarned")).alias("pass"))


@query(
    "album_reports", "A8", "page",
    """SELECT album_id, count(*) AS pages_found, count(*) FILTER (state <> 'failed') AS pages_ok, count(*) FILTER (state = 'failed') AS pages_failed, count(*) FILTER (state = 'done') AS pdf_pages,
         string_agg(page_id || ':' || CASE WHEN state = 'failed' THEN 'failed' ELSE 'ok' END, ',' ORDER BY position, page_id) AS pages FROM page GROUP BY album_id""",
)
def _(t: Tables):
    p = t.page().select("album_id", "position", "page_id", F.when(F.col("state") == "failed", "failed").otherwise("ok").alias("status"), (F.col("state") == "done").alias("has_image"))
    entry = lambda e: F.concat(e["page_id"].cast("string"), F.lit(":"), e["status"])
    return C.album_report(p).withColumn("pages", F.array_join(F.transform("pages", entry), ","))
