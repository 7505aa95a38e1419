"""Page reports and warning lists, read tolerantly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGION = "struct<bbox:array<double>,location:string,shots:array<int>,cause:string,edges:array<string>,shot_boxes:map<string,array<int>>,glare_seen:double>"
WARNING = f"struct<code:string,message:string,fraction:double,locations:array<string>,regions:array<{REGION}>,glare_seen_regions:int>"
REPORT = f"struct<version:int,dpi:int,pages:array<struct<name:string,folder:string,status:string,error:string,photos:array<string>,process_key:string,print_key:string,processed:string,print:string,bleed_px:int,warnings:array<{WARNING}>>>>"


def parsed_warnings(text: Column) -> Column:
    """The warnings of a JSON list: those with a code, regions with well-formed boxes; anything else counts as none.

    A warning whose regions are not a list (older reports gave a count) keeps its code and message.
    """
    whole = F.from_json(text, f"array<{WARNING}>")
    plain = F.from_json(text, "array<struct<code:string,message:string>>")
    bare = F.transform(
        plain,
        lambda w: F.struct(
            w["code"].alias("code"), w["message"].alias("message"), F.lit(None).cast("double").alias("fraction"), F.lit(None).cast("array<string>").alias("locations"),
            F.lit(None).cast(f"array<{REGION}>").alias("regions"), F.lit(None).cast("int").alias("glare_seen_regions"),
        ),
    )
    coded = lambda a: F.filter(a, lambda w: w["code"].isNotNull())
    has = lambda a: F.coalesce(F.size(coded(a)) > 0, F.lit(False))
    listed = F.when(has(whole), coded(whole)).when(has(bare), coded(bare)).otherwise(F.array().cast(f"array<{WARNING}>"))

    def tidy(r):
        four = F.map_filter(r["shot_boxes"], lambda _, b: F.size(b) == 4)
        return r.withField("shot_boxes", four).withField("bbox", F.when(F.size(r["bbox"]) == 4, r["bbox"]))

    return F.transform(listed, lambda w: w.withField("regions", F.transform(w["regions"], tidy)).withField("message", F.coalesce(w["message"], F.lit(""))))


def parsed_outlines(text: Column) -> Column:
    """Outlines by shot id; outlines of fewer than three points are left out."""
    return F.map_filter(F.from_json(text, "map<string,array<array<double>>>"), lambda _, pts: F.size(F.filter(pts, lambda p: F.size(p) == 2)) >= 3)


def report_rows(reports: DataFrame) -> DataFrame:
    """One row per report file: its first page entry, or why there is none.

    ``reports`` has (key, text); a missing report has a null ``text``.
    """
    parsed = reports.withColumn("_r", F.from_json("text", REPORT))
    entry = F.get(F.col("_r.pages"), F.lit(0))
    error = F.when(F.col("text").isNull(), "report missing").when(entry.isNull(), "report not readable").when(entry["status"] == "failed", F.coalesce(entry["error"], F.lit("the album step failed")))
    return parsed.select("key", entry.alias("entry"), F.coalesce(F.col("_r.dpi"), F.lit(300)).alias("dpi"), error.alias("error"))
