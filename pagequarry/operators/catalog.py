"""Catalogue read models over album, page and shot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..limits import MAX_PAGES_PER_ALBUM, PENDING_STATES
from .ordered import OrderedGroups, numbered


def is_pending(state: Column, has_shots: Column) -> Column:
    return state.isin(*PENDING_STATES) & has_shots


def shot_location(shot: DataFrame, page: DataFrame) -> DataFrame:
    """Each shot with its page and album."""
    return shot.join(page.select("page_id", "album_id"), "page_id")


def shots_per_page(shot: DataFrame) -> DataFrame:
    return shot.groupBy("page_id").agg(F.count(F.lit(1)).alias("shots"))


def with_shot_count(page: DataFrame, shot: DataFrame) -> DataFrame:
    counted = page.join(shots_per_page(shot), "page_id", "left")
    return counted.withColumn("shots", F.coalesce("shots", F.lit(0)))


def album_overview(album: DataFrame, page: DataFrame, shot: DataFrame) -> DataFrame:
    """Albums with page and shot counts, the latest change first."""
    per_album = (
        with_shot_count(page, shot)
        .groupBy("album_id")
        .agg(F.count(F.lit(1)).alias("pages"), F.sum("shots").alias("shots"), F.max("changed_at").alias("updated"))
    )
    out = album.join(per_album, "album_id", "left").select(
        "album_id", "name", "page_size", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("shots", F.lit(0)).alias("shots"), "updated"
    )
    return out.orderBy(F.col("updated").desc_nulls_last(), "album_id")


def album_pages(page: DataFrame, shot: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Every page with its number by position and its shot count, one row a page."""
    kw = {} if hot_rows is None else {"hot_rows": hot_rows}
    return numbered(with_shot_count(page, shot), ["album_id"], ["position"], "number", **kw).select("album_id", "number", "page_id", "shots")


def pages_with_shots(page: DataFrame, shot: DataFrame) -> DataFrame:
    return page.join(shot.select("page_id"), "page_id", "left_semi")


def page_states(page: DataFrame, shot: DataFrame) -> DataFrame:
    """The state shown for each page: ``empty`` without shots; an error only on failed pages."""
    p = with_shot_count(page, shot)
    return p.select(
        "album_id",
        "page_id",
        F.when(F.col("shots") == 0, "empty").otherwise(F.col("state")).alias("shown_state"),
        F.when(F.col("state") == "failed", F.col("last_error")).alias("error"),
    )


def album_status(album: DataFrame, page: DataFrame, shot: DataFrame) -> DataFrame:
    """Per album: is anything pending, and is its PDF missing, out of date or current."""
    pending = (
        with_shot_count(page, shot).groupBy("album_id").agg(F.bool_or(is_pending(F.col("state"), F.col("shots") > 0)).alias("pending"))
    )
    s = album.join(pending, "album_id", "left").withColumn("pending", F.coalesce("pending", F.lit(False)))
    return s.select(
        "album_id",
        F.col("page_size").isNull().alias("waiting_for_page_size"),
        "pending",
        F.when(~F.col("pdf_was_built"), "none").when(F.col("pdf_stale") | F.col("pending"), "out_of_date").otherwise("current").alias("pdf"),
    )


def albums_to_assemble(album: DataFrame, page: DataFrame, shot: DataFrame) -> DataFrame:
    """Albums whose PDF is stale, with a page size and no pending page."""
    pending = pages_with_shots(page.filter(F.col("state").isin(*PENDING_STATES)), shot).select("album_id")
    return album.filter(F.col("pdf_stale") & F.col("page_size").isNotNull()).join(pending, "album_id", "left_anti")


def album_summary(album: DataFrame, page: DataFrame, op: DataFrame) -> DataFrame:
    """Albums with their page count and the operations still queued."""
    pages = page.groupBy("album_id").agg(F.count(F.lit(1)).alias("pages"))
    ops = op.groupBy("album_id").agg(F.count(F.lit(1)).alias("pending_ops"))
    return album.join(pages, "album_id", "left").join(ops, "album_id", "left").select(
        "album_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("pending_ops", F.lit(0)).alias("pending_ops")
    )


def reordered(listed: DataFrame, existing: DataFrame, max_pages: int = MAX_PAGES_PER_ALBUM, census: DataFrame | None = None) -> DataFrame:
    """New page order: listed pages as listed, then left-out pages with shots by first shot.

    ``listed`` is (album_id, page_id, ord), ``existing`` (album_id, page_id,
    position, first_shot, has_shots). Left-out pages without shots go. Albums
    whose new order is longer than ``max_pages`` come back ``refused`` with
    every row, so nothing is cut.
    """
    head = listed.select("album_id", "page_id", F.lit(0).alias("_part"), F.lit(None).cast("timestamp_ntz").alias("_at"), F.col("ord").alias("_ord"))
    kept = existing.filter("has_shots").join(listed.select("album_id", "page_id"), ["album_id", "page_id"], "left_anti")
    # A page without a first shot sorts before every time, as an empty text would.
    tail = kept.select("album_id", "page_id", F.lit(1).alias("_part"), F.col("first_shot").alias("_at"), F.col("position").alias("_ord"))
    rows = numbered(head.unionByName(tail), ["album_id"], ["_part", F.col("_at").asc_nulls_first(), "_ord", "page_id"], "position", census=census)
    size = rows.groupBy("album_id").agg((F.max("position") > max_pages).alias("refused"))
    return rows.join(size, "album_id").select("album_id", "page_id", "position", "refused")


def shift_positions(page: DataFrame, at: DataFrame, by: int) -> DataFrame:
    """Positions after a page at ``at.at`` was removed (``by=-1``) or before one is inserted there (``by=1``)."""
    moved = F.col("position") > F.col("at") if by < 0 else F.col("position") >= F.col("at")
    rows = page.join(at, "album_id", "left")
    if by < 0:
        rows = rows.filter(F.col("at").isNull() | (F.col("position") != F.col("at")))
    return rows.withColumn("position", F.when(moved, F.col("position") + by).otherwise(F.col("position"))).drop("at")


def cover_shot(shot: DataFrame) -> DataFrame:
    """The first shot of each page."""
    return shot.groupBy("page_id").agg(F.min_by("shot_id", F.struct("taken", "shot_id")).alias("cover"))


def target_page(page: DataFrame, target: DataFrame) -> DataFrame:
    """The chosen target page if it is still the album's, else the album's last page."""
    last = page.groupBy("album_id").agg(F.max_by("page_id", "position").alias("_last"))
    valid = target.join(page.select("album_id", F.col("page_id").alias("target_page_id")), ["album_id", "target_page_id"])
    return last.join(valid, "album_id", "left").select("album_id", F.coalesce("target_page_id", "_last").alias("page_id"))


def run_of(shot: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen shot and every later shot of its page; ``chosen`` is (page_id, shot_id)."""
    start = chosen.join(shot, ["page_id", "shot_id"]).select("page_id", F.struct("taken", "shot_id").alias("_start"))
    return shot.join(start, "page_id").filter(F.struct("taken", "shot_id") >= F.col("_start")).drop("_start")


def claim_order(page: DataFrame, album: DataFrame, shot: DataFrame, free: int) -> DataFrame:
    """The ``free`` pages that have been ready longest, of albums with a page size."""
    ready = pages_with_shots(page.filter(F.col("state") == "ready"), shot)
    sized = album.filter(F.col("page_size").isNotNull()).select("album_id", "page_size")
    return ready.join(sized, "album_id").orderBy("changed_at", "page_id").limit(free)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key by ``order``, the later entry of ``order`` deciding ties."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def neighbours(page: DataFrame) -> DataFrame:
    """The page before and the page after each page."""
    before = OrderedGroups(page, ["album_id"], ["position"]).shifted(-1, previous=F.col("page_id"))
    return OrderedGroups(before, ["album_id"], ["position"]).shifted(1, following=F.col("page_id"))


def on_phone(server: DataFrame, phone: DataFrame) -> DataFrame:
    return server.join(phone.select("album_id", F.lit(True).alias("on_phone")).distinct(), "album_id", "left").withColumn("on_phone", F.coalesce("on_phone", F.lit(False)))


def session_pages(server_pages: DataFrame, local_pages: DataFrame) -> DataFrame:
    """Page order of an opened album: the unsent local order on top, server pages it does not know after it.

    Both sides are (album_id, page_id, ord). Albums without a local order keep
    the server's.
    """
    rest = server_pages.join(local_pages.select("album_id", "page_id"), ["album_id", "page_id"], "left_anti")
    rows = local_pages.withColumn("_side", F.lit(0)).unionByName(rest.withColumn("_side", F.lit(1)))
    return numbered(rows, ["album_id"], ["_side", "ord", "page_id"], "number").drop("_side", "ord")


def taken_time(exif, arrival):
    """When a photo was taken: its EXIF time, else its arrival."""
    return F.coalesce(exif, arrival)


def session_shots(server_shots: DataFrame, local_shots: DataFrame, unsent: DataFrame) -> DataFrame:
    """Shots of an opened album: the server's, and behind each page's those waiting here that the server doesn't know.

    ``server_shots`` and ``local_shots`` are (page_id, shot_id, ord); ``unsent`` (shot_id) are the ids that still wait.
    """
    waiting = local_shots.join(unsent.select("shot_id").distinct(), "shot_id", "left_semi")
    new = waiting.join(server_shots.select("page_id", "shot_id"), ["page_id", "shot_id"], "left_anti")
    rows = server_shots.select("page_id", "shot_id", "ord", F.lit(0).alias("_side")).unionByName(new.select("page_id", "shot_id", "ord", F.lit(1).alias("_side")))
    return numbered(rows, ["page_id"], ["_side", "ord", "shot_id"], "number").withColumn("unsent", F.col("_side") == 1).drop("_side", "ord")


def session_meta(server: DataFrame, local: DataFrame) -> DataFrame:
    """Album metadata with the unsent local values in place of the server's."""
    fields = [c for c in server.columns if c != "album_id"]
    own = local.select("album_id", F.lit(True).alias("_own"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = server.join(own, "album_id", "full_outer")
    return joined.select("album_id", *[F.when(F.col("_own"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields])


def shot_ordinals(shot: DataFrame, order: list, census: DataFrame | None = None) -> DataFrame:
    """0-based ordinal of each shot on its page, as page reports number them."""
    return numbered(shot, ["page_id"], order, "_n", census=census).withColumn("ordinal", (F.col("_n") - 1)).drop("_n")


def keys_to_shot_ids(entries: DataFrame, ordinals: DataFrame, keep_unknown: bool) -> DataFrame:
    """Replace report keys (shot ordinals as text) by shot ids.

    ``entries`` has (page_id, key). Unknown keys are dropped (outlines) or stay
    as text (region boxes).
    """
    keyed = entries.withColumn("ordinal", F.expr("try_cast(key AS BIGINT)"))
    named = keyed.join(ordinals.select("page_id", "ordinal", "shot_id"), ["page_id", "ordinal"], "left" if keep_unknown else "inner")
    return named.withColumn("shot_id", F.coalesce("shot_id", "key")).drop("ordinal")


def common_dpi(page: DataFrame) -> DataFrame:
    """Per album the DPI most of its printable pages have (the lower one on a tie), and which pages are left out."""
    counts = page.groupBy("album_id", "dpi").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("album_id").agg(F.max_by("dpi", F.struct("c", (-F.col("dpi")).alias("d"))).alias("common"))
    return page.join(best, "album_id").withColumn("in_pdf", F.col("dpi") == F.col("common"))


def report_counters(page: DataFrame) -> DataFrame:
    """Album report counters from page entries with ``status`` and ``has_image``."""
    failed = F.col("status") == "failed"
    return page.groupBy("album_id").agg(
        F.count(F.lit(1)).alias("pages_found"),
        F.count_if(~failed).alias("pages_ok"),
        F.count_if(failed).alias("pages_failed"),
        F.count_if(F.col("has_image")).alias("pdf_pages"),
    )


def album_report(page: DataFrame) -> DataFrame:
    """One report an album: its counters and its page entries in order of ``position`` (at most an album's pages).

    ``page`` has (album_id, position, page_id, status, has_image).
    """
    entries = page.groupBy("album_id").agg(F.array_sort(F.collect_list(F.struct("position", "page_id", "status", "has_image"))).alias("pages"))
    return report_counters(page).join(entries, "album_id")


def strided(rows: DataFrame, keys: list[str], order: list, stride: int | Column) -> DataFrame:
    """Every ``stride``-th row of each group, the first included."""
    n = numbered(rows, keys, order, "_n")
    k = F.lit(stride) if isinstance(stride, int) else stride
    return n.filter((F.col("_n") - 1) % k == 0).drop("_n")


def spread_over(rows: DataFrame, keys: list[str], order: list, count: int) -> DataFrame:
    """At most ``count`` rows of each group, spread evenly over its order, both ends included."""
    ranked = numbered(rows, keys, order, "_n")
    size = ranked.groupBy(*keys).agg(F.max("_n").alias("_m"))
    # Rank k of the sample sits at round_half_even(k * (m - 1) / (count - 1)).
    ks = F.sequence(F.lit(0), F.lit(count - 1))
    at = F.transform(ks, lambda k: F.bround(k * (F.col("_m") - 1) / F.lit(max(count - 1, 1)), 0).cast("bigint"))
    joined = ranked.join(size, keys)
    return joined.filter((F.col("_m") <= count) | F.array_contains(at, F.col("_n") - 1)).drop("_n", "_m")
