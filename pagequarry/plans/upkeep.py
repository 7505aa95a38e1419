"""Integrity of the data folder against the index, and what goes into an album's assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import common_dpi, with_shot_count

KEY = ["album_id", "page_id", "shot_id"]


def integrity(indexed: DataFrame, files: DataFrame) -> DataFrame:
    """Photos missing from the folder, files the index does not know, and photos whose hash changed: (kind, keys)."""
    # One pass over both sides; the keys are those of single photos, so no key is heavy.
    both = indexed.select(*KEY, F.col("sha").alias("_indexed")).join(files.select(*KEY, F.col("sha").alias("_file")), KEY, "full_outer")
    kind = F.when(F.col("_file").isNull(), "missing").when(F.col("_indexed").isNull(), "extra").when(F.col("_indexed") != F.col("_file"), "changed")
    return both.select(kind.alias("kind"), *KEY).filter("kind IS NOT NULL")


def removable(files: DataFrame, album: DataFrame, page: DataFrame, shot: DataFrame) -> DataFrame:
    """Files of a data folder the index does not account for, by role (see ``sources.inventory.roles``).

    ``page`` has (album_id, page_id, run), the run that is its current output.
    """
    f = files.filter("role <> 'outside'")
    known_album = f.join(album.select("album_id"), "album_id", "left_semi")
    orphan = f.join(album.select("album_id"), "album_id", "left_anti")
    photo = known_album.filter("role = 'photo'").join(shot.select("album_id", "page_id", F.col("shot_id").alias("name")), ["album_id", "page_id", "name"], "left_anti")
    thumb = known_album.filter("role = 'thumb'").join(shot.select("album_id", F.col("shot_id").alias("name")).distinct(), ["album_id", "name"], "left_anti")
    output = known_album.filter("role = 'output'").join(page.select("album_id", "page_id", "run"), ["album_id", "page_id", "run"], "left_anti")
    always = known_album.filter(F.col("role").isin("work", "temporary"))
    parts = [d.select("path", "role") for d in (orphan, photo, thumb, output, always)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assembly(page: DataFrame, shot: DataFrame, report: DataFrame, printed: DataFrame) -> DataFrame:
    """Pages in album order with whether each goes into the PDF, and why not.

    ``page`` has (album_id, page_id, position, state, print_path); ``report``
    (page_id, dpi) for readable reports; ``printed`` (print_path) for files
    that exist. Of pages with different resolutions the most common one stays.
    """
    p = (
        with_shot_count(page, shot)
        .join(report.select("page_id", "dpi"), "page_id", "left")
        .join(printed.select("print_path", F.lit(True).alias("_file")).distinct(), "print_path", "left")
    )
    why = (
        F.when(F.col("shots") == 0, "no shots").when(F.col("state") == "failed", "failed").when(F.col("print_path").isNull(), "no print")
        .when(F.col("dpi").isNull(), "no report").when(F.col("_file").isNull(), "file missing")
    )
    p = p.withColumn("why", why)
    common = common_dpi(p.filter("why IS NULL").select("album_id", "page_id", "dpi")).select("album_id", "common").distinct()
    j = p.join(common, "album_id", "left")
    odd = F.col("why").isNull() & (F.col("dpi") != F.col("common"))
    j = j.withColumn("why", F.when(odd, "other dpi").otherwise(F.col("why")))
    return j.select("album_id", F.col("position").alias("number"), "page_id", F.col("why").isNull().alias("in_pdf"), "why")
