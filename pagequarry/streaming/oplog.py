"""The operation log in batch: what a stream of operations amounts to.

Each function takes operations with a total order (``seq``) and is the batch
form of a streaming operator. Ordered work inside an album, page or shot goes
through ``OrderedGroups``, so one busy album does not become one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..limits import MAX_SHOTS_PER_PAGE
from ..operators.ordered import OrderedGroups, numbered
from ..session import ensure_checkpoint_dir


def idempotent_puts(op: DataFrame, key: list[str], order: list[str], hot_rows: int | None = None, census: DataFrame | None = None) -> DataFrame:
    """Each put as ``stored``, ``repeat`` (same hash again) or ``conflict`` (another hash).

    ``op`` has ``kind`` (put or delete) and ``sha``. A deleted id may come
    back: the hash that counts is the first one put since the last delete.
    """
    kw = {} if hot_rows is None else {"hot_rows": hot_rows}
    deleted = (F.col("kind") == "delete").cast("int")
    groups = OrderedGroups(op, key, order, census=census, **kw)
    lives = groups.running(_life=("sum", deleted)).filter("kind = 'put'")
    rank, put = F.struct(*order), F.struct("sha", *[F.col(o).alias(f"_{o}") for o in order])
    if groups.split:
        j = lives.join(lives.groupBy(*key, "_life").agg(F.min_by(put, rank).alias("_f")), [*key, "_life"])
    else:
        # Without a hot group the rows stay where the running sum put them. A null key names no id.
        life = Window.partitionBy(*key, "_life").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        j = lives.dropna(subset=key).withColumn("_f", F.first(put).over(life))
    is_first = F.lit(True)
    for o in order:
        is_first = is_first & F.col(o).eqNullSafe(F.col(f"_f._{o}"))
    outcome = F.when(is_first, "stored").when(F.col("sha") == F.col("_f.sha"), "repeat").otherwise("conflict")
    return j.withColumn("outcome", outcome).drop("_life", "_f")


def limited(rows: DataFrame, keys: list[str], order: list, limit: int = MAX_SHOTS_PER_PAGE) -> DataFrame:
    """Rows in arrival order with those beyond ``limit`` marked refused; nothing is dropped."""
    return numbered(rows, keys, order, "arrival").withColumn("refused", F.col("arrival") > limit)


def page_positions(op: DataFrame) -> DataFrame:
    """Pages created at the album's end in the order operations first named them."""
    first = op.groupBy("album_id", "page_id").agg(F.min("seq").alias("seq"))
    return numbered(first, ["album_id"], ["seq"], "position").drop("seq")


def idle_islands(op: DataFrame, keys: list[str], idle_seconds: float, hot_rows: int | None = None) -> DataFrame:
    """Stretches of changes less than ``idle_seconds`` apart; a gap of exactly that length ends one.

    ``ready_at`` is when the stretch has been idle for long enough.
    """
    kw = {} if hot_rows is None else {"hot_rows": hot_rows}
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = op.withColumn("_us", us)
    lagged = OrderedGroups(rows, keys, ["_us", "seq"], **kw).shifted(-1, _before=F.col("_us"))
    gap = F.lit(int(idle_seconds * 1_000_000))
    opens = (F.col("_before").isNull() | (F.col("_us") - F.col("_before") >= gap)).cast("int")
    islands = OrderedGroups(lagged.withColumn("_open", opens), keys, ["_us", "seq"], **kw).running(island=("sum", F.col("_open")))
    out = islands.groupBy(*keys, "island").agg(F.min("_us").alias("start_us"), F.max("_us").alias("end_us"), F.count(F.lit(1)).alias("changes"))
    return out.withColumn("ready_us", F.col("end_us") + gap)


def last_moves(moves: DataFrame) -> DataFrame:
    """Where each shot ends up: its last move."""
    return moves.groupBy("album_id", "shot_id").agg(F.max_by("page_id", "seq").alias("page_id"))


def surviving(puts: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """Puts with no later delete of the same key."""
    last = deletes.groupBy(*keys).agg(F.max("seq").alias("_deleted"))
    j = puts.join(last, keys, "left")
    return j.filter(F.col("_deleted").isNull() | (F.col("_deleted") < F.col("seq"))).drop("_deleted")


def run_outcomes(run: DataFrame) -> DataFrame:
    """What a finished run amounts to, and the page's next state.

    ``run`` has the claim's ``gen``, the page's ``page_gen`` (null: gone),
    ``has_shots``, ``output``, ``error`` and ``ready_at`` (a later page came meanwhile).
    """
    moved = F.col("page_gen") != F.col("gen")
    outcome = (
        F.when(F.col("page_gen").isNull(), "gone")
        .when(F.col("output").isNull() & F.col("has_shots") & F.col("error").isNotNull() & ~moved, "failed")
        .when(F.col("output").isNull() | ~F.col("has_shots"), "discarded")
        .otherwise("adopted")
    )
    state = F.when(F.col("page_gen").isNull(), None).when(moved, F.when(F.col("ready_at").isNotNull(), "ready").otherwise("changed")).when(F.col("error").isNotNull(), "failed").otherwise("done")
    return run.withColumn("outcome", outcome).withColumn("next_state", state)


def recovered(page: DataFrame) -> DataFrame:
    """After a restart, interrupted runs did not happen: their pages are changed again, whatever came meanwhile."""
    return page.withColumn("state", F.when(F.col("state") == "processing", "changed").otherwise(F.col("state")))


def abandoned(page: DataFrame) -> DataFrame:
    """A run that was stopped: its page (``abandoned``) waits again, ready if a later page came meanwhile."""
    back = F.when(F.col("ready_at").isNotNull(), "ready").otherwise("changed")
    return page.withColumn("state", F.when(F.col("abandoned") & (F.col("state") == "processing"), back).otherwise(F.col("state")))


def next_page_ready(page: DataFrame, newest: DataFrame) -> DataFrame:
    """Changed pages with shots before the newest page of their album become ready; running ones are marked for it.

    ``newest`` is (album_id, newest), the largest position that has just appeared.
    """
    j = page.join(newest, "album_id", "left")
    before = F.coalesce(F.col("position") < F.col("newest"), F.lit(False)) & F.col("has_shots")
    ready = before & (F.col("state") == "changed")
    marked = before & (F.col("state") == "processing") & (F.col("change_gen") != F.col("run_gen"))
    return j.withColumn("marked", ready | marked).withColumn("state", F.when(ready, "ready").otherwise(F.col("state"))).drop("newest")


def resized(page: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages with shots run again when their album's size changed (a running page keeps its state)."""
    change = before.select("album_id", F.col("page_size").alias("_old")).join(after.select("album_id", F.col("page_size").alias("_new")), "album_id").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select("album_id", F.lit(True).alias("_c"))
    j = page.join(change, "album_id", "left")
    hit = F.coalesce("_c", F.lit(False)) & F.col("has_shots")
    return j.withColumn("change_gen", F.col("change_gen") + hit.cast("int")).withColumn("state", F.when(hit & (F.col("state") != "processing"), "changed").otherwise(F.col("state"))).drop("_c")


def accepted_feedback(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Stored feedback after a poll: a row asked for before the stored mark is ignored, an equal time replaces it."""
    s = stored.select("page_id", F.col("fetched_at").alias("_at"), F.col("state").alias("_state"))
    j = s.join(fetched, "page_id", "full_outer")
    keep_old = F.col("fetched_at").isNull() | (F.col("_at") > F.col("fetched_at"))
    return j.select("page_id", F.when(keep_old, F.col("_at")).otherwise(F.col("fetched_at")).alias("fetched_at"), F.when(keep_old, F.col("_state")).otherwise(F.col("state")).alias("state"))


def confirmed_changes(op: DataFrame) -> DataFrame:
    """Feedback marks that follow from confirmed puts, deletes and moves: the page counts as changed from then on."""
    touched = op.filter(F.col("kind").isin("PUT_SHOT", "DELETE_SHOT", "MOVE_SHOTS") & (F.col("outcome") == "done"))
    return touched.groupBy("page_id").agg(F.max("ts").alias("fetched_at")).withColumn("state", F.lit("changed"))


def newly_warned_by_poll(warned: DataFrame, polls: DataFrame) -> DataFrame:
    """Pages that became warned at each poll: warned now, not at the album's poll before, whatever its number.

    Nothing is new at an album's first poll. ``warned`` is (album_id, poll, page_id), ``polls`` (album_id, poll)
    every poll made, once each.
    """
    looked = OrderedGroups(polls, ["album_id"], ["poll"]).shifted(-1, _last=F.col("poll")).filter(F.col("_last").isNotNull())
    now = warned.join(looked, ["album_id", "poll"])
    before = warned.select("album_id", F.col("poll").alias("_last"), "page_id")
    return now.join(before, ["album_id", "_last", "page_id"], "left_anti").select("album_id", "poll", "page_id")


def _cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def thinned(uses: DataFrame, keys: list[str], seconds: float, hot_rows: int | None = None) -> DataFrame:
    """Of each key's times (``us``) the first, and then always the first one at least ``seconds`` after the last kept.

    Each time points to the first one far enough after it, found in one ordered pass; the chain from a key's first time
    is followed by doubling: the pointers of a round jump twice as far as those of the round before, so the rounds
    grow with the logarithm of the longest chain and one busy key is spread over all tasks.
    """
    kw = {} if hot_rows is None else {"hot_rows": hot_rows}
    gap = int(seconds * 1_000_000)
    times = _cut(uses.select(*keys, "us").distinct())
    probes = times.select(*keys, (-(F.col("us") + gap)).alias("_back"), F.lit(1).alias("_probe"), "us")
    marks = times.select(*keys, (-F.col("us")).alias("_back"), F.lit(0).alias("_probe"), "us")
    seen = OrderedGroups(marks.unionByName(probes), keys, ["_back", "_probe", "us"], **kw).running(_next=("min", F.when(F.col("_probe") == 0, F.col("us"))))
    jump = _cut(seen.filter("_probe = 1 AND _next IS NOT NULL").select(*keys, "us", "_next"))
    kept = new = _cut(times.groupBy(*keys).agg(F.min("us").alias("us")))
    while not new.isEmpty():
        new = _cut(kept.join(jump, [*keys, "us"]).select(*keys, F.col("_next").alias("us")))
        kept = _cut(kept.unionByName(new))
        far = jump.select(*keys, F.col("us").alias("_next"), F.col("_next").alias("_far"))
        jump = _cut(jump.join(far, [*keys, "_next"]).select(*keys, "us", F.col("_far").alias("_next")))
    return kept


def _last_metadata(queue: DataFrame) -> DataFrame:
    """The queue without metadata that newer metadata of the album replaced before it was sent."""
    last = queue.filter("kind = 'ALBUM_META'").groupBy("album_id").agg(F.max("seq").alias("_last"))
    kept = (F.col("kind") != "ALBUM_META") | F.col("in_flight") | (F.col("seq") == F.col("_last"))
    return queue.join(last, "album_id", "left").filter(kept).drop("_last")


def phone_compacted(queue: DataFrame) -> DataFrame:
    """The phone's queue (seq, album_id, kind, shot_id, in_flight) after newer operations replaced unsent ones.

    A delete drops every put of its shot queued before it, and is itself sent; operations in flight stay.
    """
    last = queue.filter("kind = 'DELETE_SHOT'").groupBy("shot_id").agg(F.max("seq").alias("_deleted"))
    gone = (F.col("kind") == "PUT_SHOT") & ~F.col("in_flight") & F.coalesce(F.col("_deleted") > F.col("seq"), F.lit(False))
    return _last_metadata(queue).join(last, "shot_id", "left").filter(~gone).select(*queue.columns)


def scanner_compacted(queue: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """The scanner's queue after newer operations replaced unsent ones: a delete and the oldest waiting put of its shot cancel out.

    A delete that finds no put waiting is sent. So is one whose oldest waiting put is in flight, and then every
    later one, as that put stays the oldest. Puts wait in order, so the n-th delete that finds one takes the n-th put.
    """
    kw = {} if hot_rows is None else {"hot_rows": hot_rows}
    q = _last_metadata(queue)
    put, delete = (F.col("kind") == "PUT_SHOT").cast("int"), (F.col("kind") == "DELETE_SHOT").cast("int")
    shots = q.filter("kind in ('PUT_SHOT', 'DELETE_SHOT')")
    counted = OrderedGroups(shots, ["shot_id"], ["seq"], census=queue, **kw).running(_balance=("sum", put - delete), _puts=("sum", put), _deletes=("sum", delete))
    lowest = OrderedGroups(counted, ["shot_id"], ["seq"], census=queue, **kw).running(_low=("min", F.least("_balance", F.lit(0))))
    steps = OrderedGroups(lowest, ["shot_id"], ["seq"], census=queue, **kw).shifted(-1, _before=F.col("_low"))
    met = (F.col("kind") == "DELETE_SHOT") & (F.col("_low") == F.coalesce("_before", F.lit(0)))
    steps = steps.withColumn("_met", F.when(met, F.col("_deletes") + F.col("_low")))
    held = F.min(F.when(F.col("in_flight") & (F.col("kind") == "PUT_SHOT"), F.col("_puts")))
    ends = steps.groupBy("shot_id").agg(F.max("_met").alias("_all"), held.alias("_held"))
    taken = F.least(F.coalesce("_all", F.lit(0)), F.coalesce(F.col("_held") - 1, F.lit((1 << 63) - 1)))
    j = steps.join(ends, "shot_id").withColumn("_taken", taken)
    gone = F.when(F.col("kind") == "PUT_SHOT", F.col("_puts") <= F.col("_taken")).otherwise(F.coalesce(F.col("_met") <= F.col("_taken"), F.lit(False)))
    return q.filter("kind not in ('PUT_SHOT', 'DELETE_SHOT')").unionByName(j.filter(~gone).select(*queue.columns))


def drained(op: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """How far a queue gets in order: operations until the first that must be retried (which counts one attempt).

    ``op`` has (album_id, seq, outcome) with outcome done, drop, retry, auth or blocked.
    """
    kw = {} if hot_rows is None else {"hot_rows": hot_rows}
    stops = F.col("outcome").isin("retry", "auth", "blocked").cast("int")
    r = OrderedGroups(op, ["album_id"], ["seq"], **kw).running(_stops=("sum", stops))
    step = F.when(F.col("_stops") == 0, F.when(F.col("outcome") == "done", "sent").otherwise("dropped")).when((F.col("_stops") == 1) & (stops == 1), "tried").otherwise("waiting")
    return r.withColumn("step", step).drop("_stops")


def stale_albums(change: DataFrame) -> DataFrame:
    """Albums whose PDF is out of date: any change of pages, order or name since it was built."""
    return change.groupBy("album_id").agg(F.max(F.when(F.col("kind") == "built", F.col("seq"))).alias("_b"), F.max(F.when(F.col("kind") != "built", F.col("seq"))).alias("_c")).select(
        "album_id", F.coalesce(F.col("_c") > F.coalesce("_b", F.lit(-1)), F.lit(False)).alias("pdf_stale")
    )


def order_snapshots(op: DataFrame) -> DataFrame:
    """The page order each album's last metadata operation carried: (album_id, page_id, ord)."""
    last = op.filter("kind = 'ALBUM_META'").groupBy("album_id").agg(F.max_by("pages", "seq").alias("pages"))
    return last.select("album_id", F.posexplode("pages").alias("ord", "page_id"))
