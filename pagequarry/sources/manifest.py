"""Album manifests: strict keys, page entries as names or objects, errors that name their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pages import BINDINGS, CROPS, CURVATURE_MODES, FITS, ROTATIONS, SLEEVE_MODES
from ..functions.text import page_size, slug

ALBUM_KEYS = ("title", "page_size", "fit", "pages")
PAGE_KEYS = ("folder", "name", "page_size", "rotate", "fit", "curvature", "binding", "sleeve", "crop")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("album"), F.col("value").alias("text"))


def manifest_pages(manifests: DataFrame, default_size: str = "letter") -> tuple[DataFrame, DataFrame]:
    """Page specs of good manifests, and every error of the others: (album, text) to (pages, rejects).

    Sizes fall back from the page to the manifest to ``default_size``.
    """
    m = manifests.select(
        "album", "text", F.json_object_keys("text").alias("keys"),
        *[F.get_json_object("text", f"$.{k}").alias(k) for k in ("title", "page_size", "fit")], F.from_json(F.get_json_object("text", "$.pages"), "array<string>").alias("entries"),
    )
    allowed = lambda keys, ok: F.array_except(keys, F.array(*[F.lit(k) for k in ok]))
    has = lambda keys, k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    rule = lambda cond, text: F.when(cond, text if not isinstance(text, str) else F.lit(text))
    album_errors = F.array_compact(F.array(
        rule(F.col("keys").isNull(), "must be a JSON object"),
        rule(F.size(allowed(F.col("keys"), ALBUM_KEYS)) > 0, F.concat(F.lit("unknown key(s) "), F.array_join(F.array_sort(allowed(F.col("keys"), ALBUM_KEYS)), ", "))),
        rule(has(F.col("keys"), "page_size") & page_size(F.col("page_size")).isNull(), "page_size: cannot be parsed"),
        rule(has(F.col("keys"), "fit") & ~F.coalesce(F.col("fit").isin(*FITS), F.lit(False)), "fit: not a choice"),
        rule(has(F.col("keys"), "pages") & F.col("entries").isNull(), "pages must be a list"),
        rule(F.col("keys").isNotNull() & ~has(F.col("keys"), "pages"), "no pages listed"),
        rule(F.size("entries") == 0, "no pages found"),
    ))
    m = m.withColumn("errors", album_errors)
    e = m.select("album", F.col("page_size").alias("album_size"), F.col("fit").alias("album_fit"), F.posexplode("entries").alias("k", "raw"))
    entry_keys = F.json_object_keys("raw")
    e = e.withColumn("keys", entry_keys).withColumn("folder", F.when(F.col("keys").isNotNull(), F.get_json_object("raw", "$.folder")).otherwise(F.when(~F.col("raw").rlike(r"^\s*[\[{0-9]"), F.col("raw"))))
    for k in PAGE_KEYS[1:]:
        e = e.withColumn(k, F.get_json_object("raw", f"$.{k}"))
    choice = lambda k, ok: rule(F.col(k).isNotNull() & ~F.col(k).isin(*ok), f"{k}: not a choice")
    where = F.concat(F.lit("pages["), F.col("k"), F.lit("]: "))
    page_errors = F.array_compact(F.array(
        rule(F.col("folder").isNull(), "must be a folder name or an object with a 'folder'"),
        rule(F.size(allowed(F.col("keys"), PAGE_KEYS)) > 0, F.concat(F.lit("unknown key(s) "), F.array_join(F.array_sort(allowed(F.col("keys"), PAGE_KEYS)), ", "))),
        rule(has(F.col("keys"), "page_size") & page_size(F.col("page_size")).isNull(), "page_size: cannot be parsed"),
        choice("fit", FITS), choice("curvature", CURVATURE_MODES), choice("binding", BINDINGS), choice("sleeve", SLEEVE_MODES), choice("crop", CROPS),
        choice("rotate", tuple(str(r) for r in ROTATIONS)),
    ))
    e = e.withColumn("errors", page_errors)
    twice = e.filter(F.col("folder").isNotNull()).groupBy("album", "folder").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rejects = (
        m.select("album", F.explode("errors").alias("error"))
        .unionByName(e.select("album", F.explode(F.transform("errors", lambda t: F.concat(where, t))).alias("error")))
        .unionByName(twice.select("album", F.concat(F.lit("folder '"), "folder", F.lit("' is listed twice")).alias("error")))
    )
    good = e.join(rejects.select("album").distinct(), "album", "left_anti")
    pages = good.select(
        "album", (F.col("k") + 1).alias("index"), "folder", F.coalesce(F.col("name"), F.col("folder")).alias("name"), slug(F.col("folder")).alias("slug"),
        page_size(F.coalesce("page_size", "album_size", F.lit(default_size))).alias("size"), F.coalesce(F.col("rotate").cast("int"), F.lit(0)).alias("rotate"),
        F.coalesce("fit", "album_fit").alias("fit"), "curvature", "binding", "sleeve", "crop",
    )
    return pages, rejects
