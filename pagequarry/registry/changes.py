"""Change-stream queries: batch forms with SQL, and the streams themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..limits import WAIT_SECONDS
from ..mappings import Tables
from ..operators import catalog as C
from ..streaming import oplog as OL
from ..streaming import stateful as ST
from . import query

ORDER = ["arrival_a", "arrival_b", "arrival_c", "sha", "bytes", "taken"]


@query(
    "upload_outcomes_by_id", "J1", "upload",
    """WITH u AS (SELECT *, row_number() OVER w AS n, first_value(sha) OVER w AS first_sha FROM (SELECT DISTINCT * FROM upload) WINDOW w AS (PARTITION BY page_id, shot_id ORDER BY arrival_a, arrival_b, arrival_c, sha, bytes, taken))
       SELECT page_id, shot_id, CASE WHEN n = 1 THEN 'stored' WHEN sha = first_sha THEN 'repeat' ELSE 'conflict' END AS outcome, count(*) AS uploads FROM u GROUP BY ALL""",
)
def _(t: Tables):
    puts = t.uploads_once().withColumn("kind", F.lit("put"))
    return OL.idempotent_puts(puts, ["page_id", "shot_id"], ORDER, census=t.upload().select("page_id", "shot_id")).groupBy("page_id", "shot_id", "outcome").agg(F.count(F.lit(1)).alias("uploads"))


@query(
    "puts_after_deletes", "J1 J8", "op",
    """WITH o AS (SELECT seq, album_id, shot_no, kind, CAST(floor(value) AS BIGINT) % 3 AS sha, sum(CASE WHEN kind = 'DELETE_SHOT' THEN 1 ELSE 0 END) OVER (PARTITION BY album_id, shot_no ORDER BY seq) AS life FROM op WHERE kind IN ('PUT_SHOT', 'DELETE_SHOT')),
       p AS (SELECT *, first_value(sha) OVER w AS first_sha, row_number() OVER w AS n FROM o WHERE kind = 'PUT_SHOT' WINDOW w AS (PARTITION BY album_id, shot_no, life ORDER BY seq))
       SELECT seq, album_id, shot_no, CASE WHEN n = 1 THEN 'stored' WHEN sha = first_sha THEN 'repeat' ELSE 'conflict' END AS outcome FROM p""",
)
def _(t: Tables):
    o = t.op().filter("kind IN ('PUT_SHOT', 'DELETE_SHOT')").withColumn("sha", F.floor("value").cast("bigint") % 3).withColumn("kind", F.when(F.col("kind") == "PUT_SHOT", "put").otherwise("delete"))
    return OL.idempotent_puts(o, ["album_id", "shot_no"], ["seq"]).select("seq", "album_id", "shot_no", "outcome")


@query(
    "shot_limits", "J2", "op",
    "SELECT seq, album_id, page_no, row_number() OVER (PARTITION BY album_id, page_no ORDER BY seq) AS arrival, row_number() OVER (PARTITION BY album_id, page_no ORDER BY seq) > 5 AS refused FROM op WHERE kind = 'PUT_SHOT'",
)
def _(t: Tables):
    return OL.limited(t.op().filter("kind = 'PUT_SHOT'"), ["album_id", "page_no"], ["seq"], 5).select("seq", "album_id", "page_no", "arrival", "refused")


@query(
    "page_positions", "J3", "op",
    "SELECT album_id, page_no AS page_id, row_number() OVER (PARTITION BY album_id ORDER BY min(seq)) AS position FROM op GROUP BY album_id, page_no",
)
def _(t: Tables):
    return OL.page_positions(t.op().withColumnRenamed("page_no", "page_id"))


IDLE = 6 * 3600
_ISLANDS = f"""WITH o AS (SELECT album_id, page_no, seq, epoch_us(ts) // 1000 AS ms FROM op), l AS (SELECT *, CASE WHEN ms - lag(ms) OVER w < {IDLE * 1000} THEN 0 ELSE 1 END AS opens FROM o WINDOW w AS (PARTITION BY album_id, page_no ORDER BY ms, seq)),
       i AS (SELECT *, sum(opens) OVER (PARTITION BY album_id, page_no ORDER BY ms, seq) AS island FROM l)
       SELECT album_id, page_no, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS changes FROM i GROUP BY album_id, page_no, island"""


def _ms(t: Tables):
    return t.op().withColumn("ts", F.timestamp_millis(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")))


@query("idle_islands", "J5", "op", _ISLANDS)
def _(t: Tables):
    i = OL.idle_islands(_ms(t), ["album_id", "page_no"], IDLE)
    ms = lambda c: F.floor(F.col(c) / 1000).cast("bigint")
    return i.select("album_id", "page_no", ms("start_us").alias("start_ms"), ms("end_us").alias("end_ms"), "changes")


def _event_stream(t: Tables):
    schema = t.raw("events").schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(t.dir)


@query("idle_session_stream", "J5 A6", "op", _ISLANDS)
def _(t: Tables):
    # The same stretches from a stream: those that its watermark has closed, and those that its state holds when it has ended.
    k = F.get_json_object("props", "$.k").cast("int")
    op = _event_stream(t).select("ts", F.col("user_id").alias("album_id"), (k % 10).alias("page_no"))
    keys, root = ["album_id", "page_no"], ST.work_folder(t.spark, "idle")
    closed = ST.run_to_table(ST.idle_sessions(op, keys, IDLE), f"{root}/table", f"{root}/checkpoint")
    s = closed.unionByName(ST.open_sessions(t.spark, keys, f"{root}/checkpoint"))
    return s.select(*keys, F.unix_millis("w.start").alias("start_ms"), F.unix_millis("last_change").alias("end_ms"), "changes")


def _run(t: Tables, name: str, stream):
    root = ST.work_folder(t.spark, name)
    return ST.run_to_table(stream, f"{root}/table", f"{root}/checkpoint")


def _us():
    return F.unix_micros(F.col("ts").cast("timestamp"))


@query("album_state_stream", "J1 J2 J3 J4 J5 J6 J7 J8 J10 J16 J17 J19 A6", "")
def _(t: Tables):
    # All ten kinds, with page orders; claims and run ends name pages that other operations have touched.
    k, n, v = F.get_json_object("props", "$.k").cast("int"), F.col("event_id") % 40, F.floor("value").cast("bigint")
    kind = F.col("event_type")
    said = F.when(n == 7, "CLAIM").when(n == 17, "RUN_END").when(n == 27, "TICK").when(F.col("event_id") % 120 == 37, "RECOVER").when(F.col("event_id") % 200 == 3, "DELETE_PAGE").when(F.col("event_id") % 1000 == 13, "DELETE_ALBUM")
    said = F.coalesce(said, F.when(kind.isin("view", "click"), "PUT_SHOT").when(kind == "signup", "ALBUM_META").when(kind == "error", "DELETE_SHOT").otherwise("MOVE_SHOTS"))
    pages = F.array_join(F.transform(F.sequence(F.lit(0), k % 4), lambda i: F.concat(F.lit("p"), (k + 3 * i) % 10)), ",")
    op = _event_stream(t).select(
        F.col("user_id").alias("album_id"), F.col("event_id").alias("seq"), _us().alias("us"), said.alias("kind"), F.concat(F.lit("p"), F.when(said == "MOVE_SHOTS", k + F.col("event_id")).otherwise(k) % 10).alias("page_id"),
        F.when(said == "MOVE_SHOTS", F.concat_ws(",", F.concat(F.lit("s"), k), F.concat(F.lit("s"), k + 10))).otherwise(F.concat(F.lit("s"), k)).alias("shot_id"),
        F.when(said == "ALBUM_META", F.when(v % 10 == 0, "a4").otherwise("letter")).when((said == "RUN_END") & (v % 4 == 0), "").otherwise((v % 3).cast("string")).alias("sha"),
        F.lit(0).cast("bigint").alias("gen"), F.when(said == "ALBUM_META", pages).otherwise("").alias("pages"),
    )
    return _run(t, "albums", ST.album_transitions(op, IDLE))


_PUTS = f"""WITH o AS (SELECT album_id, 'p' || page_no AS page_id, epoch_us(ts) AS us, seq FROM op), s AS (SELECT *, row_number() OVER (PARTITION BY album_id, page_id ORDER BY us, seq) AS n FROM o QUALIFY n <= 25),
       l AS (SELECT *, lead(us) OVER (PARTITION BY album_id, page_id ORDER BY us, seq) AS next FROM s)"""


@query(
    "idle_promotions", "J5", "op",
    _PUTS + f""" SELECT album_id, page_id, us + {IDLE} * 1000000::BIGINT AS ready_us FROM l
       WHERE (next IS NULL OR next - us >= {IDLE} * 1000000::BIGINT) AND (us + {IDLE} * 1000000::BIGINT) // 1000 < (SELECT max(us) FROM o) // 1000 - {WAIT_SECONDS * 1000}""",
)
def _(t: Tables):
    # Uploads alone: pages become ready at their due time by timers, without a later operation of the album.
    k = F.get_json_object("props", "$.k").cast("int")
    put = F.struct(F.lit("PUT_SHOT").alias("kind"), F.lit("h").alias("sha"), (2 * F.col("event_id") + 1).alias("seq"))
    meta = F.struct(F.lit("ALBUM_META").alias("kind"), F.lit("letter").alias("sha"), (2 * F.col("event_id")).alias("seq"))
    op = _event_stream(t).withColumn("o", F.explode(F.array(meta, put))).select(
        F.col("user_id").alias("album_id"), "o.seq", _us().alias("us"), "o.kind", F.concat(F.lit("p"), k % 10).alias("page_id"),
        F.concat(F.lit("s"), "event_id").alias("shot_id"), "o.sha", F.lit(0).cast("bigint").alias("gen"), F.lit("").alias("pages"),
    )
    return _run(t, "idle", ST.album_transitions(op, IDLE)).filter("event = 'ready'").select("album_id", "page_id", F.col("us").alias("ready_us"))


@query(
    "run_results_stream", "J9 J10", "",
    f"""WITH c AS (SELECT event_id // 2 AS run, ts AS claimed_at, CASE WHEN value < 20 THEN 2 ELSE 1 END AS page_gen, CAST(floor(value) AS BIGINT) % 5 <> 0 AS has_shots, CAST(floor(value) AS BIGINT) % 3 = 0 AS later FROM events WHERE event_id % 2 = 0 AND event_type <> 'error'),
       e AS (SELECT event_id // 2 AS run, ts AS ended_at, event_type = 'view' AS bad FROM events WHERE event_id % 2 = 1 AND event_type <> 'signup'),
       w AS (SELECT least((SELECT max(claimed_at) FROM c), (SELECT max(ended_at) FROM e)) - INTERVAL {WAIT_SECONDS} SECONDS AS w),
       j AS (SELECT coalesce(c.run, e.run) AS run, claimed_at, ended_at, page_gen, has_shots, later, bad FROM c FULL JOIN e ON c.run = e.run AND ended_at BETWEEN claimed_at AND claimed_at + INTERVAL 600 SECONDS)
       SELECT run, epoch_us(claimed_at) AS claimed_us, epoch_us(ended_at) AS ended_us, CASE WHEN claimed_at IS NULL THEN 'gone' WHEN ended_at IS NULL THEN 'abandoned' WHEN bad AND has_shots AND page_gen = 1 THEN 'failed' WHEN bad OR NOT has_shots THEN 'discarded' ELSE 'adopted' END AS outcome,
         CASE WHEN claimed_at IS NULL THEN NULL WHEN ended_at IS NULL OR page_gen <> 1 THEN CASE WHEN later THEN 'ready' ELSE 'changed' END WHEN bad THEN 'failed' ELSE 'done' END AS next_state
       FROM j, w WHERE (claimed_at IS NOT NULL AND ended_at IS NOT NULL) OR ended_at <= w OR claimed_at + INTERVAL 600 SECONDS <= w""",
)
def _(t: Tables):
    v = F.floor("value").cast("bigint")
    run = F.expr("event_id DIV 2").alias("run")
    claims = _event_stream(t).filter("event_id % 2 = 0 AND event_type <> 'error'").select(
        run, F.col("ts").cast("timestamp").alias("claimed_at"), F.lit(1).alias("gen"), F.when(F.col("value") < 20, 2).otherwise(1).alias("page_gen"), (v % 5 != 0).alias("has_shots"), F.when(v % 3 == 0, 1).alias("ready_at"),
    )
    bad = F.col("event_type") == "view"
    ends = _event_stream(t).filter("event_id % 2 = 1 AND event_type <> 'signup'").select(run, F.col("ts").cast("timestamp").alias("ended_at"), F.when(~bad, "out").alias("output"), F.when(bad, "error").alias("error"))
    found = _run(t, "runs", ST.run_results(claims, ends, 600))
    return found.select("run", F.unix_micros("claimed_at").alias("claimed_us"), F.unix_micros("ended_at").alias("ended_us"), "outcome", "next_state")


@query(
    "last_moves", "J7", "op",
    "SELECT album_id, shot_no AS shot_id, max_by(page_no, seq) AS page_id FROM op WHERE kind = 'MOVE_SHOTS' GROUP BY album_id, shot_no",
)
def _(t: Tables):
    return OL.last_moves(t.op().filter("kind = 'MOVE_SHOTS'").withColumnRenamed("shot_no", "shot_id").withColumnRenamed("page_no", "page_id"))


@query(
    "surviving_puts", "J8", "op",
    """SELECT seq, album_id, shot_no FROM op p WHERE kind = 'PUT_SHOT' AND NOT EXISTS (SELECT 1 FROM op d WHERE d.kind = 'DELETE_SHOT' AND d.album_id = p.album_id AND d.shot_no = p.shot_no AND d.seq > p.seq)""",
)
def _(t: Tables):
    o = t.op()
    return OL.surviving(o.filter("kind = 'PUT_SHOT'"), o.filter("kind = 'DELETE_SHOT'").select("album_id", "shot_no", "seq"), ["album_id", "shot_no"]).select("seq", "album_id", "shot_no")


@query(
    "run_outcomes", "J9", "page shot",
    """WITH r AS (SELECT page_id, 1 AS gen, CASE WHEN priority = '4-NOT SPECIFIED' THEN NULL WHEN priority = '2-HIGH' THEN 2 ELSE 1 END AS page_gen, page_id IN (SELECT page_id FROM shot) AS has_shots, total < 250000 AS ok, total > 400000 AS later FROM page)
       SELECT page_id, CASE WHEN page_gen IS NULL THEN 'gone' WHEN NOT ok AND has_shots AND page_gen = gen THEN 'failed' WHEN NOT ok OR NOT has_shots THEN 'discarded' ELSE 'adopted' END AS outcome,
         CASE WHEN page_gen IS NULL THEN NULL WHEN page_gen <> gen THEN CASE WHEN later THEN 'ready' ELSE 'changed' END WHEN ok THEN 'done' ELSE 'failed' END AS next_state FROM r""",
)
def _(t: Tables):
    p = C.with_shot_count(t.page_base(), t.upload())
    r = p.select(
        "page_id", F.lit(1).alias("gen"), F.when(F.col("priority") == "4-NOT SPECIFIED", None).when(F.col("priority") == "2-HIGH", 2).otherwise(1).alias("page_gen"), (F.col("shots") > 0).alias("has_shots"),
        F.when(F.col("total") < 250000, "out").alias("output"), F.when(F.col("total") >= 250000, "error").alias("error"), F.when(F.col("total") > 400000, F.lit(1)).alias("ready_at"),
    )
    return OL.run_outcomes(r).select("page_id", "outcome", "next_state")


@query("recovered_pages", "J10", "page", "SELECT page_id, CASE WHEN state = 'processing' THEN 'changed' ELSE state END AS state FROM page")
def _(t: Tables):
    return OL.recovered(t.page_base()).select("page_id", "state")


@query(
    "abandoned_pages", "J10", "page",
    "SELECT page_id, CASE WHEN state = 'processing' AND priority <> '5-LOW' THEN CASE WHEN total > 150000 THEN 'ready' ELSE 'changed' END ELSE state END AS state FROM page",
)
def _(t: Tables):
    p = t.page_base().withColumn("ready_at", F.when(F.col("total") > 150000, F.col("changed_at"))).withColumn("abandoned", F.col("priority") != "5-LOW")
    return OL.abandoned(p).select("page_id", "state")


@query(
    "next_page_ready", "J6", "page shot",
    """WITH n AS (SELECT album_id, max(position) AS newest FROM page WHERE priority = '1-URGENT' GROUP BY album_id),
       j AS (SELECT p.*, coalesce(position < newest, false) AND page_id IN (SELECT page_id FROM shot) AS earlier, total > 200000 AS moved FROM page p LEFT JOIN n ON n.album_id = p.album_id)
       SELECT page_id, CASE WHEN earlier AND state = 'changed' THEN 'ready' ELSE state END AS state, earlier AND (state = 'changed' OR (state = 'processing' AND moved)) AS marked FROM j""",
)
def _(t: Tables):
    p = C.with_shot_count(t.page(), t.upload()).withColumn("has_shots", F.col("shots") > 0).withColumn("run_gen", F.lit(1)).withColumn("change_gen", F.when(F.col("total") > 200000, 2).otherwise(1))
    newest = p.filter("priority = '1-URGENT'").groupBy("album_id").agg(F.max("position").alias("newest"))
    return OL.next_page_ready(p, newest).select("page_id", "state", "marked")


@query(
    "resized_albums", "J17", "album page shot",
    """SELECT page_id, CASE WHEN a.pdf_stale AND has AND state <> 'processing' THEN 'changed' ELSE state END AS state, CASE WHEN a.pdf_stale AND has THEN 2 ELSE 1 END AS change_gen
       FROM (SELECT *, page_id IN (SELECT page_id FROM shot) AS has FROM page) p JOIN album a ON a.album_id = p.album_id""",
)
def _(t: Tables):
    a = t.album()
    p = C.with_shot_count(t.page_base(), t.upload()).withColumn("has_shots", F.col("shots") > 0).withColumn("change_gen", F.lit(1))
    after = a.withColumn("page_size", F.when(F.col("pdf_stale"), "a3").otherwise(F.col("page_size")))
    return OL.resized(p, a, after).select("page_id", "state", "change_gen")


@query(
    "accepted_feedback", "J11 J18", "op",
    """WITH s AS (SELECT album_id * 10 + page_no AS page_id, max(seq) AS seq FROM op WHERE kind IN ('PUT_SHOT', 'DELETE_SHOT', 'MOVE_SHOTS') AND value >= 20 GROUP BY ALL),
       f AS (SELECT album_id * 10 + page_no AS page_id, max(seq) AS seq FROM op WHERE kind = 'ALBUM_META' GROUP BY ALL)
       SELECT coalesce(s.page_id, f.page_id) AS page_id, CASE WHEN f.seq IS NULL OR s.seq > f.seq THEN 'changed' ELSE 'done' END AS state FROM s FULL JOIN f ON f.page_id = s.page_id""",
)
def _(t: Tables):
    o = t.op().withColumn("page_id", (F.col("album_id") * 10 + F.col("page_no")))
    marks = OL.confirmed_changes(o.withColumn("outcome", F.when(F.col("value") >= 20, "done").otherwise("retry")).withColumn("ts", F.col("seq")))
    fetched = o.filter("kind = 'ALBUM_META'").groupBy("page_id").agg(F.max("seq").alias("fetched_at")).withColumn("state", F.lit("done"))
    return OL.accepted_feedback(marks, fetched).select("page_id", "state")


@query(
    "newly_warned_by_poll", "J12", "op",
    """WITH o AS (SELECT DISTINCT album_id, CAST(floor(date_diff('day', TIMESTAMP '2024-01-01', ts)) AS BIGINT) AS poll, page_no AS page_id, kind FROM op), w AS (SELECT DISTINCT album_id, poll, page_id FROM o WHERE kind = 'PUT_SHOT'), p AS (SELECT album_id, poll, lag(poll) OVER (PARTITION BY album_id ORDER BY poll) AS last FROM (SELECT DISTINCT album_id, poll FROM o))
       SELECT w.album_id, w.poll, w.page_id FROM w JOIN p ON p.album_id = w.album_id AND p.poll = w.poll WHERE p.last IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w AS v WHERE v.album_id = w.album_id AND v.poll = p.last AND v.page_id = w.page_id)""",
)
def _(t: Tables):
    o = t.op().select("album_id", F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("poll"), F.col("page_no").alias("page_id"), "kind")
    return OL.newly_warned_by_poll(o.filter("kind = 'PUT_SHOT'").drop("kind").distinct(), o.select("album_id", "poll").distinct())


_DAY = 86_400_000_000


@query(
    "newly_warned_stream", "J12", "op",
    f"""WITH o AS (SELECT DISTINCT album_id, CAST(floor(date_diff('day', TIMESTAMP '2024-01-01', ts)) AS BIGINT) AS poll, page_no, kind FROM op), w AS (SELECT DISTINCT album_id, poll, page_no FROM o WHERE kind = 'PUT_SHOT'), p AS (SELECT album_id, poll, lag(poll) OVER (PARTITION BY album_id ORDER BY poll) AS last FROM (SELECT DISTINCT album_id, poll FROM o)),
       z AS (SELECT max(epoch_us(ts)) // 1000 - {WAIT_SECONDS * 1000} - epoch_us(TIMESTAMP '2024-01-01') // 1000 AS done FROM op)
       SELECT w.album_id, w.poll, 'p' || w.page_no AS page_id FROM w JOIN p ON p.album_id = w.album_id AND p.poll = w.poll, z
       WHERE p.poll - p.last <= 4 AND (w.poll + 1) * 86400000 <= z.done AND NOT EXISTS (SELECT 1 FROM w AS v WHERE v.album_id = w.album_id AND v.poll = p.last AND v.page_no = w.page_no)""",
)
def _(t: Tables):
    # A poll a day; what was warned is forgotten four days after its poll.
    k = F.get_json_object("props", "$.k").cast("int")
    poll = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    first = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = _event_stream(t).select(
        F.col("user_id").alias("album_id"), _us().alias("us"), F.col("event_id").alias("seq"), poll.alias("poll"), (first + (poll + 1) * _DAY).alias("until_us"),
        F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("p"), k % 10)).alias("page_id"),
    )
    return _run(t, "warned", ST.newly_warned(rows, 4 * 86_400))


@query(
    "thinned_marks", "J15", "",
    """WITH RECURSIVE u AS (SELECT DISTINCT event_type || user_id % 20 AS token, epoch_us(ts) AS us FROM events),
       k AS (SELECT token, min(us) AS us FROM u GROUP BY token UNION ALL SELECT k.token, (SELECT min(u.us) FROM u WHERE u.token = k.token AND u.us >= k.us + 43200000000) FROM k WHERE k.us IS NOT NULL)
       SELECT token, us FROM k WHERE us IS NOT NULL""",
)
def _(t: Tables):
    uses = t.raw("events").select(F.concat("event_type", F.col("user_id") % 20).alias("token"), _us().alias("us"))
    return OL.thinned(uses, ["token"], 43_200)


@query(
    "thinned_mark_stream", "J15", "",
    """WITH RECURSIVE u AS (SELECT DISTINCT event_type || user_id % 20 AS token, epoch_us(ts) AS us FROM events),
       k AS (SELECT token, min(us) AS us FROM u GROUP BY token UNION ALL SELECT k.token, (SELECT min(u.us) FROM u WHERE u.token = k.token AND u.us >= k.us + 43200000000) FROM k WHERE k.us IS NOT NULL)
       SELECT token, us FROM k WHERE us IS NOT NULL""",
)
def _(t: Tables):
    uses = _event_stream(t).select(F.concat("event_type", F.col("user_id") % 20).alias("token"), _us().alias("us"))
    return _run(t, "marks", ST.touched_tokens(uses, 43_200))


_QUEUE = """WITH RECURSIVE q AS (SELECT seq, album_id, kind, album_id || '/' || shot_no AS shot_id, value > 90 AS in_flight FROM op WHERE kind <> 'MOVE_SHOTS'), ml AS (SELECT album_id, max(seq) AS l FROM q WHERE kind = 'ALBUM_META' GROUP BY album_id),
       q2 AS (SELECT q.* FROM q LEFT JOIN ml ON ml.album_id = q.album_id WHERE kind <> 'ALBUM_META' OR in_flight OR seq = l)"""

# One operation after another, for all shots at once: what waits is a list of (seq, in flight), oldest first.
_ONE_BY_ONE = """, o AS (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY seq) AS i FROM q2 WHERE kind IN ('PUT_SHOT', 'DELETE_SHOT')),
       st AS (SELECT DISTINCT shot_id, 0::BIGINT AS i, []::STRUCT(s BIGINT, f BOOLEAN)[] AS waiting, NULL::BIGINT AS put, NULL::BIGINT AS del FROM o
              UNION ALL SELECT o.shot_id, o.i, CASE WHEN o.kind = 'PUT_SHOT' THEN list_append(waiting, {'s': o.seq, 'f': o.in_flight}) WHEN len(waiting) > 0 AND NOT waiting[1].f THEN waiting[2:] ELSE waiting END,
                               CASE WHEN o.kind = 'DELETE_SHOT' AND len(waiting) > 0 AND NOT waiting[1].f THEN waiting[1].s END, CASE WHEN o.kind = 'DELETE_SHOT' AND len(waiting) > 0 AND NOT waiting[1].f THEN o.seq END
                        FROM st JOIN o ON o.shot_id = st.shot_id AND o.i = st.i + 1)
       SELECT seq, album_id, kind, shot_id FROM q2 WHERE seq NOT IN (SELECT put FROM st WHERE put IS NOT NULL) AND seq NOT IN (SELECT del FROM st WHERE del IS NOT NULL)"""


def _queue(t: Tables):
    return t.op().filter("kind <> 'MOVE_SHOTS'").select("seq", "album_id", "kind", F.concat("album_id", F.lit("/"), "shot_no").alias("shot_id"), (F.col("value") > 90).alias("in_flight"))


@query("phone_queue_compacted", "J13", "op", _QUEUE + """ SELECT seq, album_id, kind, shot_id FROM q2 WHERE kind <> 'PUT_SHOT' OR in_flight OR NOT EXISTS (SELECT 1 FROM q d WHERE d.kind = 'DELETE_SHOT' AND d.shot_id = q2.shot_id AND d.seq > q2.seq)""")
def _(t: Tables):
    return OL.phone_compacted(_queue(t)).drop("in_flight")


@query("scanner_queue_compacted", "J13", "op", _QUEUE + _ONE_BY_ONE)
def _(t: Tables):
    return OL.scanner_compacted(_queue(t)).drop("in_flight")


@query(
    "queue_drained", "J14", "op",
    """WITH o AS (SELECT seq, album_id, CASE WHEN value > 75 THEN 'retry' WHEN value > 60 THEN 'drop' ELSE 'done' END AS outcome FROM op), r AS (SELECT *, sum(CASE WHEN outcome = 'retry' THEN 1 ELSE 0 END) OVER (PARTITION BY album_id ORDER BY seq) AS s FROM o)
       SELECT seq, album_id, CASE WHEN s = 0 THEN CASE outcome WHEN 'done' THEN 'sent' ELSE 'dropped' END WHEN s = 1 AND outcome = 'retry' THEN 'tried' ELSE 'waiting' END AS step FROM r""",
)
def _(t: Tables):
    o = t.op().select("seq", "album_id", F.when(F.col("value") > 75, "retry").when(F.col("value") > 60, "drop").otherwise("done").alias("outcome"))
    return OL.drained(o).select("seq", "album_id", "step")


@query(
    "stale_albums", "J16", "op",
    """SELECT album_id, coalesce(max(seq) FILTER (value <= 95) > coalesce(max(seq) FILTER (value > 95), -1), false) AS pdf_stale FROM op GROUP BY album_id""",
)
def _(t: Tables):
    return OL.stale_albums(t.op().select("album_id", "seq", F.when(F.col("value") > 95, "built").otherwise("change").alias("kind")))


@query(
    "order_snapshots", "J19", "op",
    """WITH m AS (SELECT album_id, max_by(shot_no, seq) AS k FROM op WHERE kind = 'ALBUM_META' GROUP BY album_id) SELECT album_id, CAST(i AS INTEGER) AS ord, 'p' || (k + i) AS page_id FROM m, (SELECT unnest(range(3)) AS i)""",
)
def _(t: Tables):
    pages = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("p"), F.col("shot_no") + i))
    return OL.order_snapshots(t.op().withColumn("pages", pages))
