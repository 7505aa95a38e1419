"""Page feedback read models: which pages are warned, pending, or ask for another shot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..limits import ANOTHER_SHOT_CODES, AREA_CODES, PENDING_STATES


def settled(feedback: DataFrame) -> DataFrame:
    """Feedback of pages the server has finished with; older warnings are not shown."""
    return feedback.filter(~F.col("state").isin(*PENDING_STATES))


def current_warnings(feedback: DataFrame, warning: DataFrame) -> DataFrame:
    return warning.join(settled(feedback).select("page_id", "album_id"), "page_id")


def warned_pages(feedback: DataFrame, warning: DataFrame, queued: DataFrame) -> DataFrame:
    """Pages with a current area warning and no upload still queued."""
    area = current_warnings(feedback, warning.filter(F.col("code").isin(*AREA_CODES)))
    return area.join(queued, "page_id", "left_anti").select("page_id", "album_id").distinct()


def warned_counts(warned: DataFrame) -> DataFrame:
    return warned.groupBy("album_id").agg(F.count(F.lit(1)).alias("warned"))


def known_feedback(feedback: DataFrame, page: DataFrame) -> DataFrame:
    """Feedback of pages the catalogue still has."""
    return feedback.join(page.select("page_id"), "page_id", "left_semi")


def work_left(page: DataFrame, feedback: DataFrame, queued: DataFrame, warned: DataFrame) -> DataFrame:
    """Per album: pages with shots still pending, and warned pages that are not pending."""
    p = (
        page.filter(F.col("shots") > 0)
        .select("album_id", "page_id")
        .join(feedback.select("page_id", F.col("state").alias("_fb")), "page_id", "left")
        .join(queued.select("page_id", F.lit(True).alias("_queued")).distinct(), "page_id", "left")
        .join(warned.select("page_id", F.lit(True).alias("_warned")).distinct(), "page_id", "left")
    )
    pending = F.coalesce("_queued", F.lit(False)) | F.col("_fb").isNull() | F.col("_fb").isin(*PENDING_STATES)
    warned_left = F.coalesce("_warned", F.lit(False)) & ~pending
    return p.groupBy("album_id").agg(F.count_if(warned_left).alias("warned"), F.count_if(pending).alias("pending"))


def other_warned(page: DataFrame, feedback: DataFrame, warning: DataFrame, warned: DataFrame, target: DataFrame) -> DataFrame:
    """Warned pages asking for another shot, other than the album's target page."""
    asking = current_warnings(feedback, warning.filter(F.col("code").isin(*ANOTHER_SHOT_CODES))).select("page_id")
    return (
        page.join(asking, "page_id", "left_semi")
        .join(warned.select("page_id"), "page_id", "left_semi")
        .join(target.select("album_id", "page_id"), ["album_id", "page_id"], "left_anti")
    )


def notice(other: DataFrame) -> DataFrame:
    """Per album the lowest-numbered such page, and how many more there are."""
    n = other.groupBy("album_id").agg(
        F.min_by("page_id", "position").alias("page_id"), F.min("position").alias("number"), (F.count(F.lit(1)) - 1).alias("more")
    )
    # Fixed wording.
    text = F.concat(F.lit("Page "), F.col("number"), F.lit(" needs another shot"), F.when(F.col("more") > 0, F.concat(F.lit(", and "), F.col("more"), F.lit(" more"))).otherwise(""))
    return n.withColumn("text", text)


def newly_warned(current: DataFrame, before: DataFrame, looked: DataFrame) -> DataFrame:
    """Pages warned now that were not at the last look; nothing for an album looked at for the first time.

    ``looked`` has the albums that were looked at before.
    """
    return current.join(before, ["album_id", "page_id"], "left_anti").join(looked.select("album_id"), "album_id", "left_semi")


def dashed_regions(region: DataFrame) -> DataFrame:
    """Whether each region is drawn dashed: less glare seen in it than in the k-th most glared of its warning.

    ``region`` has (page_id, code, k, glare_seen, ...), ``k`` being how many
    regions of the warning had glare seen; null when nobody looked.
    """
    keys = ["page_id", "code"]
    # The cut-off is the k-th largest value: count how many values are at or above each distinct one.
    seen = region.filter(F.col("glare_seen").isNotNull()).groupBy(*keys, "k", "glare_seen").agg(F.count(F.lit(1)).alias("_c"))
    from .ordered import OrderedGroups

    upto = OrderedGroups(seen, [*keys, "k"], [F.col("glare_seen").desc()]).running(_upto=("sum", F.col("_c")))
    cutoff = upto.filter(F.col("_upto") >= F.col("k")).groupBy(*keys, "k").agg(F.max("glare_seen").alias("_cutoff"))
    joined = region.join(cutoff, [*keys, "k"], "left")
    dashed = (
        F.when(F.col("k").isNull() | F.col("glare_seen").isNull() | (F.col("code") != "single_coverage"), False)
        .when(F.col("k") <= 0, True)
        .otherwise(F.coalesce(F.col("glare_seen") < F.col("_cutoff"), F.lit(False)))
    )
    return joined.withColumn("dashed", dashed).drop("_cutoff")


def first_photo_with_box(shot: DataFrame, shot_box: DataFrame) -> DataFrame:
    """Per page the first photo, in capture order, that one of its regions has a box in."""
    boxed = shot.join(shot_box.select("page_id", "shot_id"), ["page_id", "shot_id"], "left_semi")
    return boxed.groupBy("page_id").agg(F.min_by("shot_id", F.struct("taken", "shot_id")).alias("shot_id"))


def photo_lines(shot: DataFrame, warning: DataFrame, region: DataFrame) -> DataFrame:
    """The warning lines for each photo: where to look instead when no region of the warning is in it.

    ``warning`` has (page_id, ord, code, message), ``region`` (page_id, ord,
    region, location, shot_id) with one row per region and photo it is in
    (``shot_id`` null when it is in none).
    """
    shown = warning.filter(F.trim("message") != "")
    per_photo = shot.select("page_id", "shot_id").join(shown, "page_id")
    inside = region.filter(F.col("shot_id").isNotNull()).select("page_id", "ord", "shot_id", F.lit(True).alias("_in")).distinct()
    # Distinct places in the order they first appear; places are the nine location words, so the list is short.
    first_seen = region.filter(F.col("location").isNotNull()).groupBy("page_id", "ord", "location").agg(F.min("region").alias("_at"))
    places = first_seen.groupBy("page_id", "ord").agg(F.array_sort(F.collect_list(F.struct("_at", "location"))).alias("_places"))
    where = F.concat_ws(", ", F.transform("_places", lambda s: s["location"]))
    lines = per_photo.join(inside, ["page_id", "ord", "shot_id"], "left").join(places, ["page_id", "ord"], "left")
    elsewhere = F.col("code").isin(*AREA_CODES) & F.col("_in").isNull() & F.col("_places").isNotNull()
    # Fixed wording.
    text = F.when(elsewhere, F.concat("message", F.lit(" Not in this photo; look at the "), where, F.lit("."))).otherwise(F.col("message"))
    return lines.select("page_id", "shot_id", "ord", "code", text.alias("text"))
