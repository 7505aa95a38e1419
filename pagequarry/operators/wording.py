"""Warnings of a page in words, from its counted regions. The texts are fixed wording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pages import percent, place_word


def region_summary(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and the largest region of each page: ``n``, ``single`` and ``largest`` (a location word)."""
    return regions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("cause") == "single_shot").alias("single"), F.min_by("location", "ord").alias("largest")
    )


def glare_message(s: DataFrame) -> DataFrame:
    n, single = F.col("n"), F.col("single")
    where = F.when(n == 1, F.col("largest")).otherwise(F.concat(F.lit("largest "), "largest"))
    head = F.concat(F.lit("Glare remains on "), percent(F.col("fraction")), F.lit(" of the page in "), n, F.when(n > 1, " areas (").otherwise(" area ("), where, F.lit(")."))
    tail = (
        F.when((single == n) & (n == 1), " It was seen by only one photo; add a shot of that area from a different angle.")
        .when(single == n, " Each was seen by only one photo; add shots of those areas from a different angle.")
        .when(single > 0, F.concat(F.lit(" "), single, F.when(single == 1, " of them was").otherwise(" of them were"), F.lit(" seen by only one photo; add shots of those areas from a different angle. Every photo had glare on the rest; change the light or the camera angle for those.")))
        .otherwise(" Every photo had glare there; change the light or the camera angle for all the shots.")
    )
    return s.withColumn("message", F.concat(head, tail))


def shadow_message(s: DataFrame) -> DataFrame:
    n, single = F.col("n"), F.col("single")
    head = F.when(n == 1, F.concat(F.lit("A shadow remains on "), percent(F.col("fraction")), F.lit(" of the page ("), "largest", F.lit(")."))).otherwise(
        F.concat(F.lit("Shadows remain on "), percent(F.col("fraction")), F.lit(" of the page in "), n, F.lit(" areas (largest "), "largest", F.lit(")."))
    )
    add = F.when(n == 1, " add a shot of that area without the shadow.").otherwise(" add shots of those areas without the shadow.")
    move = F.lit(" hold the phone so that you and it are not between the light and the page.")
    tail = (
        F.when(single == n, F.concat(F.when(n == 1, " Only one photo covers it;").otherwise(" Only one photo covers each;"), add))
        .when(single == 0, F.concat(F.when(n == 1, " Every photo has it;").otherwise(" Every photo has them;"), move))
        .otherwise(F.concat(F.lit(" "), single, F.when(single == 1, " of them is").otherwise(" of them are"), F.lit(" in one photo only; add shots of those areas without the shadow. Every photo has the rest;"), move))
    )
    return s.withColumn("message", F.concat(head, tail))


def uncovered_message(regions: DataFrame, fractions: DataFrame, keys: list[str]) -> DataFrame:
    """Regions need ``place``; distinct places are named in the order they first appear (there are nine words)."""
    placed = regions.withColumn("place", place_word(F.col("location"), F.size("edges") > 0))
    first = placed.groupBy(*keys, "place").agg(F.min("ord").alias("at"))
    places = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "place"))), lambda s: s["place"]), ", ").alias("places"))
    j = places.join(fractions, keys)
    return j.withColumn("message", F.concat(percent(F.col("fraction")), F.lit(" of the page is not in any photo ("), "places", F.lit(").")))


def single_coverage_message(regions: DataFrame, fractions: DataFrame, keys: list[str], glare_seen: float = 0.02) -> DataFrame:
    """The largest region with glare seen is named first; without any, the largest region."""
    r = regions.withColumn("place", place_word(F.col("location"), F.size("edges") > 0))
    seen = F.coalesce(F.col("glare_seen") >= glare_seen, F.lit(False))
    s = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(seen).alias("glare_seen_regions"), F.min_by(F.when(seen, F.struct("place", "area")), F.when(seen, F.col("ord"))).alias("lead"), F.min_by("place", "ord").alias("largest")
    ).join(fractions, keys)
    n, lead = F.col("n"), F.col("lead")
    with_glare = F.concat(
        F.lit("Only one photo covers the "), lead["place"], F.lit(", and glare was seen there ("), percent(lead["area"]), F.lit(" of the page)."),
        F.when(n == 1, " Take another shot of that part from a different angle so that the glare can be removed.").otherwise(
            F.concat(F.lit(" "), n - 1, F.when(n > 2, " other areas are").otherwise(" other area is"), F.lit(" in one photo only too ("), percent(F.col("fraction")),
                     F.lit(" of the page in all). Take another shot of each from a different angle, starting with the "), lead["place"], F.lit(", so that glare there can be removed."))
        ),
    )
    where = F.when(n == 1, F.col("largest")).otherwise(F.concat("largest", F.lit(" and "), n - 1, F.when(n > 2, " other areas").otherwise(" other area")))
    without = F.concat(F.lit("Only one photo covers the "), where, F.lit(" ("), percent(F.col("fraction")), F.lit(" of the page). Take another shot of "), F.when(n == 1, "that part").otherwise("those parts"), F.lit(" from a different angle so that glare there can be removed."))
    return s.withColumn("message", F.when(F.col("glare_seen_regions") > 0, with_glare).otherwise(without))


def dropped_message(dropped: DataFrame, keys: list[str]) -> DataFrame:
    """``dropped`` has one row per unused photo (at most the shots of a page)."""
    s = dropped.groupBy(*keys).agg(F.array_sort(F.collect_set("photo")).alias("photos"))
    many = F.size("photos") > 1
    return s.withColumn("message", F.concat(F.when(many, "Photos ").otherwise("Photo "), F.array_join(F.transform("photos", lambda p: p.cast("string")), ", "), F.lit(" matched no other photo and "), F.when(many, "were").otherwise("was"), F.lit(" not used.")))
