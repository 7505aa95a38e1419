"""Photos and data-folder files as tables, listed in parallel by Spark's file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_photo, natural_key
from ..operators.ordered import numbered


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Paths, sizes and times of all files below ``folder``; the content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def photos(spark: SparkSession, folder: str) -> DataFrame:
    """Photos of page folders below an album folder: (folder, photo, path, ordinal).

    Hidden files and folders and other endings are left out; a folder without
    photos gives no page. Photos are in natural order.
    """
    parts = F.split("path", "/")
    files = listing(spark, folder).select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("photo"))
    kept = files.filter(is_photo(F.col("photo")) & ~F.col("folder").startswith("."))
    return numbered(kept, ["folder"], [natural_key(F.col("photo")), "photo"], "ordinal")


def hashed(spark: SparkSession, folder: str) -> DataFrame:
    """Every file with the SHA-256 of its content and whether it starts like a JPEG."""
    from ..functions.text import is_jpeg_start

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha"), is_jpeg_start(F.col("content")).alias("jpeg"))


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of decoded images: (path, y, x, b, g, r). Meant for images already shrunk to the grid."""
    img = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(folder).select("image.*")
    # Pixel bytes are unrolled per image row, so no row of the table holds more than one image line.
    rows = img.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).select(
        F.col("origin").alias("path"), "y", "width", F.col("nChannels").alias("n"), F.expr("substring(data, y * width * nChannels + 1, width * nChannels)").alias("line")
    )
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    level = lambda c: F.conv(F.hex(F.expr(f"substring(line, x * n + {c} + 1, 1)")), 16, 10).cast("int")
    b = level(0)
    return cells.select("path", "y", "x", b.alias("b"), F.when(F.col("n") >= 3, level(1)).otherwise(b).alias("g"), F.when(F.col("n") >= 3, level(2)).otherwise(b).alias("r"))


def roles(files: DataFrame, root: str = "albums") -> DataFrame:
    """What each file of the data folder is, from its ``path``: role, album, page, and name without ending."""
    rel = F.regexp_extract("path", rf"(?:^|/){root}/(.*)$", 1)
    part = F.split(rel, "/")
    n = F.size(part)
    second = F.get(part, F.lit(1))
    role = (
        F.when(rel == "", "outside").when(F.element_at(part, -1).endswith(".tmp"), "temporary")
        .when((second == "photos") & (n == 4), "photo").when((second == "thumbs") & (n == 3), "thumb")
        .when(second == "work", "work").when((second == "out") & (n >= 5), "output")
        .when((n == 2) & second.isin("album.pdf", "report.json"), "album").otherwise("unknown")
    )
    return files.select(
        "*", role.alias("role"), F.get(part, F.lit(0)).alias("album_id"),
        F.when(second.isin("photos", "out", "work"), F.get(part, F.lit(2))).alias("page_id"),
        F.when((second == "out") & (n >= 5), F.get(part, F.lit(3))).alias("run"),
        F.regexp_replace(F.element_at(part, -1), r"\.[^.]*$", "").alias("name"),
    )
